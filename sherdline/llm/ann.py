"""Nearest neighbours by an inverted multi-index.

1. Vectors are halved, and each half is quantised by its own codebook of K centroids, fitted by k-means on
   a sample of at most ``SAMPLE`` distinct vectors (taken by least hash over all rows).  A pair of centroids
   is a cell; K grows with the fourth root of the rows' square, so that a cell holds about ``CELL`` vectors.
2. A query walks the cells in the order of the sum of its two half-distances, with a heap over the two
   sorted centroid lists, until the cells met hold a given number of entries.  That number is fitted: for
   at most ``TRIALS`` queries the true neighbours are found over all entries, and it is the least with
   which the walks meet the ``TARGET`` share of them.  Data without clusters need long walks, others short.
3. Entries of the cells met are reranked by their exact distance in double precision.  Cells next to each
   other make up blocks of about ``BLOCK`` entries; a block gives a query its best, and the best of those
   are the answer.

Equal vectors stand in the index once, with their ``KEPT`` least ids: a larger id can be in no answer, as
ties go to smaller ids.  So a vector that a third of all rows share is one entry, and equal queries are
one search.  A cell of more than ``BLOCK`` entries is cut into several blocks by hash.  Only codebooks (K rows each)
and cell sizes (at most K times K numbers) reach the driver.

Vectors that are null, empty, zero, or hold a null or a non-finite number take no part; nor do rows without
an id, or vectors of another dimension than most have (ties: the smaller).  Rows that repeat an id count
once, with their least vector.  Fewer candidates than asked for are all returned; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

SAMPLE = 20_000
CELL = 32
MOST_CENTROIDS = 1024
BLOCK = 4096
NEIGHBOURS = 10
KEPT = NEIGHBOURS + 1
TRIALS = 128
TARGET = 0.96


def centroids_for(entries: int) -> int:
    return int(min(MOST_CENTROIDS, max(2, round((entries / CELL) ** 0.5))))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]]
    for _ in range(rounds):
        near = squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Codebooks of the two halves and the sizes of the cells."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)] if self.half else [np.zeros((1, 0)), kmeans(sample, k)]
        self.sizes: dict[int, int] = {}

    def block(self, size: int) -> None:
        """Numbers the blocks: neighbouring cells share one, a cell above ``size`` has several of its own."""
        cells = len(self.books[0]) * len(self.books[1])
        self.first, self.parts = np.zeros(cells, np.int64), np.ones(cells, np.int64)
        at = held = 0
        for cell in sorted(self.sizes):
            n = self.sizes[cell]
            if held and held + n > size:
                at, held = at + 1, 0
            self.first[cell], self.parts[cell] = at, -(-n // size)
            held += n
            if n > size:
                at, held = at + self.parts[cell], 0

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, wanted: float) -> list[int]:
        """Non-empty cells in the order of summed distance until they hold ``wanted`` entries."""
        first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        queue, met, held = [(a[first[0]] + b[second[0]], 0, 0)], [], 0
        while queue and held < wanted:
            _, i, j = heapq.heappop(queue)
            cell = int(first[i]) * len(second) + int(second[j])
            if size := self.sizes.get(cell):
                met.append(cell)
                held += size
            if j + 1 < len(second):
                heapq.heappush(queue, (a[first[i]] + b[second[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(first):  # each pair is reached once: along its row
                heapq.heappush(queue, (a[first[i + 1]] + b[second[0]], i + 1, 0))
        return met


def distances(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, in double precision."""
    out = np.empty((len(queries), len(entries)))
    step = max(1, 4_000_000 // max(1, entries.size))
    for at in range(0, len(queries), step):
        out[at : at + step] = np.sqrt(((queries[at : at + step, None] - entries[None]) ** 2).sum(2))
    return out


def budget(index: MultiIndex, placed: DataFrame, searches: DataFrame, neighbours: int) -> float:
    """How many entries a walk must meet to hold the target share of true neighbours, by trial queries."""
    rows = searches.orderBy(F.xxhash64("entry"), "entry").limit(TRIALS).collect()  # at most TRIALS vectors
    if not rows:
        return 0
    trials = np.array([r["embedding"] for r in rows], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, far = batch.column(0).to_numpy(), distances(trials, np.array(batch.column(3).to_pylist(), float))
            top = np.argsort(far, axis=1, kind="stable")[:, : neighbours + 1]
            at = np.repeat(np.arange(len(trials)), top.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(np.take_along_axis(far, top, 1).ravel()), pa.array(cells[top].ravel(), pa.int64())], names=["trial", "far", "cell"]
            )

    near = Window.partitionBy("trial").orderBy("far", "cell")
    found = placed.mapInArrow(run, "trial long, far double, cell long").withColumn("n", F.row_number().over(near)).filter(F.col("n") <= neighbours + 1)
    a, b = index.distances(trials)
    ends = []
    for i in range(len(trials)):
        cells = index.walk(a[i], b[i], float("inf"))
        ends.append(dict(zip(cells, np.cumsum([index.sizes[c] for c in cells]).tolist())))
    needs = sorted(ends[r["trial"]][r["cell"]] for r in found.collect())  # at most TRIALS times neighbours + 1
    return needs[min(len(needs) - 1, int(TARGET * len(needs)))]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part, each id once."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, every: int = 100, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``every`` divides, against all rows."""
    kept = neighbours + 1
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = keep(usable(vectors), "ann-rows")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == sizes[0]["size"])
    first = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= kept).groupBy("embedding").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    entries = keep(entries.select(F.col("ids")[0].alias("entry"), "ids", "embedding"), "ann-entries")
    total = entries.count()
    sample = entries.select("entry", "embedding").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("embedding").toArrow()
    index = MultiIndex(np.array(sample.column(0).to_pylist(), float), centroids_for(total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float)
            cells = index.cells(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *batch.columns], names=["cell", *batch.schema.names])

    placed = keep(entries.mapInArrow(place, "cell long, entry long, ids array<long>, embedding array<double>"), "ann-placed")
    counts = placed.groupBy("cell").count()
    index.sizes = {r["cell"]: r["count"] for r in counts.collect()}
    asked = rows.filter(F.col("vec_id") % every == 0).join(entries.select("entry", F.col("embedding").alias("e")), F.col("embedding") == F.col("e"))
    asked = keep(asked.select("vec_id", "entry", "embedding"), "ann-queries")
    searches = asked.groupBy("entry").agg(F.any_value("embedding").alias("embedding"))
    wanted = budget(index, placed, searches, neighbours)

    index.block(BLOCK)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blocks, cells = [], [], []
            if batch.num_rows:
                a, b = index.distances(np.array(batch.column(1).to_pylist(), float))
                for i in range(batch.num_rows):
                    met: dict[int, list[int]] = {}
                    for cell in index.walk(a[i], b[i], wanted):
                        for part in range(index.parts[cell]):
                            met.setdefault(int(index.first[cell]) + part, []).append(cell)
                    at += [i] * len(met)
                    blocks += met
                    cells += met.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(cells, pa.list_(pa.int64())), batch.column(0).take(rows), batch.column(1).take(rows)],
                names=["block", "cells", "entry", "embedding"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, entries = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            spread = (entries * 0x9E3779B1 >> 7) % index.parts[cells]  # any even deal will do
            yield pa.RecordBatch.from_arrays([pa.array(index.first[cells] + spread, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    probes = searches.mapInArrow(probe, "block long, cells array<long>, entry long, embedding array<double>")
    dealt = placed.mapInArrow(deal, "block long, cell long, entry long, ids array<long>, embedding array<double>")

    def best(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"entry": [], "vec_id": [], "score": []})
        held = held.sort_values("cell", kind="stable")
        cell, ids, x = held["cell"].to_numpy(), held["ids"].to_numpy(), np.stack(held["embedding"].to_numpy())
        copies = np.array([len(i) for i in ids])
        out = []
        for entry, met, q in zip(queries["entry"], queries["cells"], queries["embedding"]):
            met = np.sort(met)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(cell, met, "left"), np.searchsorted(cell, met, "right"))])
            if not len(rows):
                continue
            far = np.repeat(distances(q[None], x[rows])[0], copies[rows])
            flat = np.concatenate(ids[rows])
            top = np.lexsort((flat, far))[:kept]
            out.append((np.full(len(top), entry), flat[top], far[top]))
        if not out:
            return pd.DataFrame({"entry": [], "vec_id": [], "score": []})
        return pd.DataFrame({name: np.concatenate(column) for name, column in zip(("entry", "vec_id", "score"), zip(*out))})

    found = probes.groupBy("block").cogroup(dealt.groupBy("block")).applyInPandas(best, "entry long, vec_id long, score double")
    near = Window.partitionBy("entry").orderBy("score", "vec_id")
    found = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= kept).drop("n")
    answers = asked.select(F.col("vec_id").alias("query_id"), "entry").join(found, "entry").filter("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
