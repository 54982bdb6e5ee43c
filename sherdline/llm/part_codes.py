"""Vector codes: one byte for each quarter of a vector, by codebooks whose distances share a trie's prefixes.

A component x counts as the integer floor(1024 x).  Vectors are cut into ``PARTS`` equal parts, each with
a codebook of its own that starts as that part of the ``ENTRIES`` vectors of least vec_id.  A round assigns
every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to the
componentwise floor of the mean of its parts; an entry without parts stays.

Equal parts are brought together once, with their counts, and kept on shared storage in lexicographic
order, so that what a task reads in a row is a stretch of a trie over components.  ``assign`` walks it
depth first: the vector of distances to all entries, added up over the components so far, is computed once
for a prefix and shared by all parts that begin with it; leaves take the least entry, and their components
are summed with their counts.  Subtrees of up to ``TOGETHER`` leaves are worked on a level at a time as one
matrix, so memory is bounded whatever the data.  A round returns at most a codebook's size of sums from a
task; the codebooks (64 KB for 64 components) are all that passes through the driver.

A vector that is null, empty, or holds null or non-finite components is left out, as is one whose length
is no multiple of ``PARTS`` or differs from that of the first vector of all.  Order is by vec_id (null
last), then by the integers.  Scaled components beyond +-2^27 count as 2^27, which keeps every squared
distance exact in 64 bits.  Repeated rows and ids are rows of their own and weigh as such.  Fewer vectors
than entries make smaller codebooks; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, same

PARTS, ENTRIES, ROUNDS = 4, 256, 4
TOGETHER = 256
MOST = float(1 << 27)


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance for parts (n x d) in lexicographic order."""
    n, d = parts.shape
    nearest, least = np.empty(n, np.int64), np.empty(n, np.int64)
    if not n:
        return nearest, least
    #: how many leading components a part shares with the one before it
    same_up_to = np.zeros(n, np.int64)
    if n > 1:
        same_up_to[1:] = np.cumprod(parts[1:] == parts[:-1], axis=1).sum(axis=1)
    columns = np.ascontiguousarray(book.T)

    def leaves(start: int, stop: int, depth: int, above: np.ndarray) -> None:
        """The forest of parts start..stop below a prefix of ``depth`` components, level by level."""
        added, of = above[None, :], np.zeros(stop - start, np.int64)
        for level in range(depth, d):
            opens = same_up_to[start:stop] <= level
            opens[0] = True
            first = np.flatnonzero(opens)
            added = added[of[first]] if len(first) > len(added) else added
            gap = parts[start + first, level][:, None] - columns[level][None, :]
            added = added + gap * gap
            of = np.cumsum(opens) - 1
        best = added.argmin(axis=1)
        nearest[start:stop] = best[of]
        least[start:stop] = added[np.arange(len(best)), best][of]

    stack = [(0, n, 0, np.zeros(len(book), np.int64))]
    while stack:
        start, stop, depth, above = stack.pop()
        if stop - start <= TOGETHER or depth == d:
            leaves(start, stop, depth, above)
            continue
        edges = [start, *(start + 1 + np.flatnonzero(same_up_to[start + 1 : stop] <= depth)).tolist(), stop]
        begun = start  # children from here on wait to be worked on together
        for a, b in zip(edges, edges[1:]):
            if b - a > TOGETHER:
                if begun < a:
                    leaves(begun, a, depth, above)
                gap = parts[a, depth] - columns[depth]
                stack.append((a, b, depth + 1, above + gap * gap))
                begun = b
            elif b - begun > TOGETHER:
                leaves(begun, a, depth, above)
                begun = a
        if begun < stop:
            leaves(begun, stop, depth, above)
    return nearest, least


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, ints of the vectors that take part, whatever their length."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * 1024.0, F.lit(-MOST)), F.lit(MOST))).cast("int"))
    fits = (F.size(x) > 0) & (F.size(x) % PARTS == 0)
    return embeddings.filter(x.isNotNull() & fits & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", scaled.alias("ints"))


def seeds(rows: DataFrame) -> list[list[int]]:
    return [r.ints for r in rows.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).collect()]


def distinct_parts(rows: DataFrame, width: int) -> DataFrame:
    """place, part, n: each distinct part of each place with its count, in lexicographic order."""
    cut = F.array(*[F.struct(F.lit(p).alias("place"), F.slice("ints", p * width + 1, width).alias("part")) for p in range(PARTS)])
    parts = rows.select(F.explode(cut).alias("p")).groupBy("p.place", "p.part").agg(F.count(F.lit(1)).alias("n"))
    return parts.repartitionByRange("place", "part").sortWithinPartitions("place", "part")


def sums_of_round(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """place, entry, component, total, n: what the parts of each entry add up to."""
    shared = parts.sparkSession.sparkContext.broadcast(books)
    names = ["place", "entry", "component", "total", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        totals, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            places, part, n = (batch.column(i) for i in range(3))
            places, part, n = places.to_numpy(), matrix(part, books.shape[2]), n.to_numpy()
            for place in np.unique(places):
                at = places == place
                nearest, _ = assign(part[at], books[place])
                np.add.at(totals[place], nearest, part[at] * n[at][:, None])
                np.add.at(counts[place], nearest, n[at])
        place, entry = np.nonzero(counts)
        width = books.shape[2]
        columns = [np.repeat(place, width), np.repeat(entry, width), np.tile(np.arange(width), len(place)), totals[place, entry].ravel(), np.repeat(counts[place, entry], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    sums = parts.mapInArrow(run, ", ".join(f"{name} long" for name in names))
    return sums.groupBy(*names[:3]).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def codebooks(rows: DataFrame, first: list[list[int]]) -> np.ndarray:
    """Entries as integers by part, entry and component after all rounds."""
    width = len(first[0]) // PARTS
    books = np.array(first, np.int64).reshape(len(first), PARTS, width).swapaxes(0, 1).copy()
    parts = keep(distinct_parts(rows, width), "parts")
    for _ in range(ROUNDS):
        for r in sums_of_round(parts, books).collect():  # a codebook's size at most
            books[r.place, r.entry, r.component] = r.total // r.n
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error for rows of ``integers``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            vectors = matrix(batch.column(2), books.shape[0] * books.shape[2]).reshape(-1, books.shape[0], books.shape[2])
            codes, errors = np.empty(vectors.shape[:2], np.uint8), np.zeros(len(vectors), np.int64)
            for place, book in enumerate(books):
                parts, of = np.unique(vectors[:, place], axis=0, return_inverse=True)
                nearest, least = assign(parts, book)
                codes[:, place] = nearest[of.ravel()]
                errors += least[of.ravel()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def part_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that takes part."""
    rows = integers(embeddings)
    first = seeds(rows)
    if not first:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.filter(F.size("ints") == len(first[0]))
    if any(len(v) != len(first[0]) for v in first):
        first = seeds(rows)
    books = codebooks(rows, first)
    coded = keep(encode(rows, books), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(totals, same(F.col("label"), F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rows in DuckDB's SQL: every distinct part meets every entry of its place in every round."""
    gap = "list_sum(list_transform(list_zip(p.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    ctes = [f"""all_rows AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(least(greatest(1024 * x::DOUBLE, -134217728), 134217728))::BIGINT) AS ints
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS id FROM all_rows
  WHERE len(ints) = (SELECT len(ints) FROM all_rows ORDER BY vec_id NULLS LAST, ints LIMIT 1)
), cut AS MATERIALIZED (
  SELECT id, place, ints[len(ints) // {PARTS} * place + 1 : len(ints) // {PARTS} * (place + 1)] AS part FROM kept, range({PARTS}) t(place)
), parts AS MATERIALIZED (SELECT place, part, count(*) AS n FROM cut GROUP BY ALL),
book0 AS (SELECT place, id - 1 AS slot, part AS entry FROM cut WHERE id <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (
  SELECT place, part, any_value(n) AS n, min((gap, slot)) AS best FROM (
    SELECT p.place, p.part, p.n, b.slot, {gap} AS gap FROM parts p JOIN book{k} b ON b.place = p.place
  ) GROUP BY place, part)""")
        if k < ROUNDS:
            ctes.append(f"""moved{k} AS (
  SELECT place, slot, list(floor_mean ORDER BY component) AS entry FROM (
    SELECT place, slot, component, (total - ((total % n) + n) % n) // n AS floor_mean FROM (
      SELECT place, best[2] AS slot, component, sum(part[component] * n)::BIGINT AS total, sum(n)::BIGINT AS n
      FROM (SELECT *, unnest(range(1, len(part) + 1)) AS component FROM near{k}) GROUP BY ALL)
  ) GROUP BY place, slot
), book{k + 1} AS MATERIALIZED (
  SELECT b.place, b.slot, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN moved{k} m ON m.place = b.place AND m.slot = b.slot)""")
    last = ROUNDS
    return "WITH " + ",\n".join(ctes) + f""",
coded AS (
  SELECT k.id, any_value(k.vec_id) AS vec_id, any_value(k.label) AS label, string_agg(printf('%02x', n.best[2]), '' ORDER BY c.place) AS code, sum(n.best[1])::BIGINT AS error
  FROM kept k JOIN cut c ON c.id = k.id JOIN near{last} n ON n.place = c.place AND n.part = c.part GROUP BY k.id
), totals AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY label)
SELECT c.vec_id, c.code, c.error, t.label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY place, slot)) FROM book{last}) AS codebooks_sha256
FROM coded c JOIN totals t ON t.label IS NOT DISTINCT FROM c.label
"""
