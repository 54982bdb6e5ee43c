"""The trie of conversation prefixes, rolled up in depth bands.

Conversations are first rebuilt: conversation c begins with the first h turns of conversation c - c % 5
(all it has, if fewer; none, if there is no such conversation), where h = crc32(decimal c) % 9, and goes
on with its own turns after its first h.  Every distinct sequence of first d turns is a node.

A node is known by its depth and two 64-bit values: the exclusive or, over its turns, of hashes of place,
role and text.  These are running values, so that no conversation is ever held whole: turns are numbered
and hashed in blocks of ``BLOCK``, and a block's total is carried to the blocks after it.

Sums over subtrees go by bands.  Depths are cut into bands of ``HEIGHT``; a node adds its values to its
ancestors inside its band only, which are at most ``HEIGHT``.  The first nodes of all bands then form a
trie that is ``HEIGHT`` times less deep, and are rolled up in the same way, until one band holds all.
On the way back the completed totals of a band's first nodes are added to their ancestors in the band
above, again at most ``HEIGHT``.  A trie of depth D takes log(D) rounds each way.

Rows with a null conv_id belong to no conversation and are left out.  Turns are ordered by turn (null
first), those of equal number by role and then by the MD5 of the text; repeated rows are turns of their
own.  A null role or text is empty.  c % 5 keeps the sign of c, so ids around zero share conversation 0.
An empty table gives no rows, not even a root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Depths in a band.
HEIGHT = 8
#: Turns of a conversation that are numbered and hashed together.
BLOCK = 1024
#: Ids of members that are joined into one piece of text before they meet the others.
IDS = 4096
SHARED_WITH, HEAD = 5, 9
KEY = ["depth", "x1", "x2"]


def decimal_crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def preceding(order: str, keys: list[str]):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place, and what is to be known of each conversation."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    ).filter(F.col("conv_id").isNotNull())
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(float(BLOCK))), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    placed = turns.withColumn("place", F.row_number().over(inside).cast("long"))

    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    sizes = blocks.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("base", c - c % SHARED_WITH).withColumn("head", decimal_crc(c) % HEAD)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))

    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(preceding("block", ["conv_id"])), F.lit(0))).drop("n")
    known = before.join(convs.select("conv_id", "head", "taken", "length"), "conv_id")
    placed = placed.join(known, ["conv_id", "block"]).withColumn("place", F.col("place") + F.col("before"))
    return placed.select("conv_id", "place", "h1", "h2", "bytes", "head", "taken", "length"), convs


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, h1, h2, bytes, last: the turns of every rebuilt conversation, and a turn of depth 0
    without hashes that stands for its start."""
    placed, convs = numbered(conversations)
    own = placed.filter(F.col("place") > F.col("head")).withColumn("depth", F.col("place") - F.col("head") + F.col("taken"))
    heads = placed.filter((F.col("conv_id") % SHARED_WITH == 0) & (F.col("place") < HEAD)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "h1", "h2", "bytes")
    shared = heads.join(convs.select("base", "conv_id", "head", "length"), "base").filter(F.col("depth") <= F.col("head"))
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(n) for n in ("h1", "h2", "bytes")], "length")
    columns = start.columns
    turns = own.select(columns).unionByName(shared.select(columns)).unionByName(start)
    return turns.select(*columns[:-1], (F.col("depth") == F.col("length")).alias("last"))


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Adds x1 and x2, which stand for the turns up to this one, and p1 and p2 for those before it."""
    depth = F.col("depth")
    turns = turns.withColumn("block", F.floor(depth / F.lit(float(BLOCK))))
    for i in "12":
        turns = turns.withColumn(f"e{i}", F.when(depth > 0, F.xxhash64(depth, f"h{i}")).otherwise(F.lit(0).cast("long")))
    carry = turns.groupBy("conv_id", "block").agg(*[F.bit_xor(f"e{i}").alias(f"c{i}") for i in "12"])
    before = preceding("block", ["conv_id"])
    carry = carry.select("conv_id", "block", *[F.bit_xor(f"c{i}").over(before).alias(f"c{i}") for i in "12"]).filter(F.col("block") > 0)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.select("*", *[F.bit_xor(f"e{i}").over(inside).alias(f"x{i}") for i in "12"])
    turns = turns.join(carry, ["conv_id", "block"], "left")
    for i in "12":
        turns = turns.withColumn(f"x{i}", F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))))
        turns = turns.withColumn(f"p{i}", F.col(f"x{i}").bitwiseXOR(F.col(f"e{i}")))
    return turns.select("conv_id", *KEY, "p1", "p2", "bytes", "last")


def bands(turns: DataFrame, unit: int, height: int) -> DataFrame:
    """For the node of every turn whose depth is a multiple of ``unit``: ``up``, its ancestors of such depths
    inside its band of ``height`` of them, itself included; and for a band's first node ``above``, those in the band before."""
    depth, span = F.col("depth"), unit * height
    band = F.floor(depth / F.lit(float(span)))
    first = (depth % span == 0) & (depth > 0)
    turns = turns.filter(depth % unit == 0).select("conv_id", *KEY, F.explode(F.when(first, F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("path", F.collect_list(F.struct(*KEY)).over(inside))  # of height + 1 turns at most
    home = F.col("band") == band
    return turns.groupBy(*KEY).agg(
        F.first(F.when(home, F.col("path")), ignorenulls=True).alias("up"),
        F.first(F.when(~home, F.slice("path", 1, height)), ignorenulls=True).alias("above"),
    )


def added_up(values: DataFrame, path: str) -> DataFrame:
    """The values of nodes summed for each node of their paths."""
    each = values.select("leaves", "saved", F.explode(path).alias("to")).select("to.*", "leaves", "saved")
    return each.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(turns: DataFrame, values: DataFrame, deepest: int, height: int) -> DataFrame:
    """leaves and saved of every node, summed over its subtree."""
    units = [1]
    while units[-1] * height <= deepest:
        units.append(units[-1] * height)
    paths = [keep(bands(turns, unit, height), "trie-paths") for unit in units]
    inside = []  # by level: totals over what of a node's subtree lies in its band
    for unit, path in zip(units, paths):
        of = inside[-1].filter(F.col("depth") % unit == 0) if inside else values
        inside.append(keep(added_up(path.select(*KEY, "up").join(of, KEY), "up"), "trie-band"))
    totals = inside.pop()
    for unit, path in reversed(list(zip(units[1:], paths))):  # a level's first nodes are the nodes of the next
        firsts = path.filter(F.col("above").isNotNull()).select(*KEY, "above").join(totals, KEY)
        more = added_up(firsts, "above").select(*KEY, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        totals = inside.pop().join(more, KEY, "left").select(
            *KEY, *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in ("leaves", "saved")]
        )
    return totals


def member_digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in a node, in order, joined by commas.

    Ids meet first in pieces of at most ``IDS``; a node's pieces then stream through one digest, which
    cannot be split, with no more than an Arrow batch of them in memory.
    """
    ends = turns.filter("last").withColumn("piece", F.floor(F.col("conv_id") / F.lit(float(IDS))))
    pieces = ends.groupBy(*KEY, "piece").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = pa.schema([(name, pa.int64()) for name in KEY] + [("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *here, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if here == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = here, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, digest.hexdigest()), schema)], schema=schema)

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return ordered.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    turns = keep(with_prefixes(rebuilt(conversations)), "trie-turns")
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    nodes = turns.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"),
    )
    nodes = keep(nodes, "trie-nodes")
    under = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(under, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    values = nodes.select(*KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = subtree_totals(turns, values, deepest, height)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, KEY).join(member_digests(turns), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL: every node goes to all its ancestors; crc32 is spelled out by its table."""
    return f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {SHARED_WITH} AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {HEAD} AS head
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), parts AS (
  SELECT c.conv_id, 0 AS part, place, said, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.head
  UNION ALL SELECT c.conv_id, 1, place, said, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.head
), whole AS (
  SELECT c.conv_id, coalesce(list(p.said ORDER BY part, place) FILTER (WHERE p.said IS NOT NULL), []) AS path,
    coalesce(list(strlen(p.text) ORDER BY part, place) FILTER (WHERE p.said IS NOT NULL), []) AS bytes
  FROM convs c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, depth, path[1:depth] AS key, len(path) = depth AS ends, CASE WHEN depth = 0 THEN 0 ELSE bytes[depth] END AS size
  FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM whole)
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, key
), children AS (
  SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT up AS depth, key[1:up] AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
    SELECT n.key, n.saved, (c.n IS NULL)::BIGINT AS leaf, unnest(range(n.depth + 1)) AS up
    FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key
  ) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key
LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
"""
