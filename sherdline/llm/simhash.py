"""SimHash near-duplicates by bit-sliced comparison.

1. A document's fingerprint: bit b is set if it is set in over half of the 64-bit hashes of its
   shingles.  Fingerprints are written once to shared storage; equal ones then count as one.
2. Candidate blocks: two fingerprints within ``RADIUS`` = 3 bits agree on one of the four quarters of
   any set of bits, so each fingerprint goes into four blocks, by quarter and value.  A block of more
   than ``BLOCK`` fingerprints is cut again by the quarters of the bits that its key leaves open.
   Fingerprints are distinct, so a block whose key leaves r bits open has at most 2^r members; the
   fifth cut leaves 16, so no block stays large and no pair is lost, whatever the skew.
3. Inside a block the fingerprints stand as 64 vertical bit planes, 64 lanes to a machine word.  For
   each shift the planes are xored with themselves shifted, and the differing bits of all lanes are
   counted together by a carry-save adder of two sum bits and an overflow bit.  Words in which every
   lane has passed the radius are abandoned.  Links leave a block as a star to each class's root, at
   most one for each member, never as all pairs.
4. Classes by large-star / small-star contraction, each round kept on shared storage.

A null text is an empty one; a document without words has fingerprint zero and links as any other.
Rows with a null id still link others; their own ``component_id`` is that of their class (null if the
class has no id at all).  Rows that repeat an id stay as they are.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, map_batches, text_bytes

SHINGLE = 3
RADIUS = 3
BLOCK = 32768
ALL = (1 << 64) - 1


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = body.lower().split()  # on bytes both work on ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def text_digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, digest: the fingerprint as a signed long with the same bits, and a hash of the text."""

    def batch(rows: dict) -> dict:
        fps = np.array([fingerprint(b, shingle) for b in rows["body"]], np.uint64).view(np.int64)
        return {"doc_id": rows["doc_id"], "fp": fps.tolist(), "digest": rows["digest"]}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), text_digest().alias("digest"))
    return map_batches(chosen, "doc_id long, fp long, digest long", batch)


# ---------------------------------------------------------------- blocks


def quarters(mask: int) -> list[int]:
    """The bits that ``mask`` leaves open, in four near-equal parts."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(open_bits, RADIUS + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(rows: DataFrame, masks: list[int]) -> DataFrame:
    """fp, mask: each row once for every finer mask of its own.  All four children agree on the parent's
    bits, so the key of a block is (mask, fp & mask)."""
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(m | q)).cast("long") for q in quarters(m)]))])
    cut = rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
    return cut if masks == [0] else cut.distinct()  # two cuts may lead to one key


def transpose(fps: np.ndarray) -> np.ndarray:
    """64 planes over the lanes, in words of 64 lanes, with one empty word at the end."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(fps) // 64)
    lanes = np.zeros((64, (words + 1) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def _count(planes: np.ndarray, over: np.ndarray, other, group: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Counts differing bits lane by lane in the words of ``over`` (bits set: lanes not asked for).

    ``other(b, at)`` gives what word ``at`` differs in at plane b.  Three sum bits suffice: a low one, a
    high one, and the overflow, which marks more than three.  Words are dropped once all lanes overflow.
    Returns the words left and their overflow bits.
    """
    alive = np.nonzero(over != np.uint64(ALL))[0]
    over = over[alive]
    low, high = np.zeros_like(over), np.zeros_like(over)
    for start in range(0, 64, group):
        for b in range(start, start + group):
            carry = other(b, alive)
            low, carry = low ^ carry, low & carry
            high, carry = high ^ carry, high & carry
            over |= carry
        left = over != np.uint64(ALL)
        if not left.all():
            alive, low, high, over = alive[left], low[left], high[left], over[left]
            if not len(alive):
                break
    return alive, over


def _open_bits(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def near_lanes(planes: np.ndarray, shift: int, lanes: int) -> np.ndarray:
    """Lanes i < ``lanes`` whose fingerprint is within the radius of that of lane i + shift."""
    words = -(-lanes // 64)
    far, bit = divmod(shift, 64)
    last = planes.shape[1] - 1
    over = np.zeros(words, np.uint64)
    over[-1] = np.uint64(ALL << (lanes - 64 * (words - 1)) & ALL)

    def other(b: int, at: np.ndarray) -> np.ndarray:
        plane = planes[b]
        moved = plane[np.minimum(at + far, last)]
        if bit:
            moved = moved >> np.uint64(bit) | plane[np.minimum(at + far + 1, last)] << np.uint64(64 - bit)
        return plane[at] ^ moved

    alive, over = _count(planes, over, other)
    at, lane = _open_bits(over)
    return alive[at] * 64 + lane


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _members(fps: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    member = np.nonzero(root != np.arange(len(root)))[0]
    return fps[member].view(np.int64), fps[root[member]].view(np.int64)


def small_links(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for every fingerprint that is not the root of its class, over many blocks at once.

    Blocks stand one after the other, largest first, so a shift concerns a prefix of the lanes.
    """
    blocks = sorted(blocks, key=len, reverse=True)
    sizes = np.array([len(b) for b in blocks])
    fps = np.concatenate(blocks)
    block = np.repeat(np.arange(len(blocks)), sizes)
    ends = np.cumsum(sizes)
    planes = transpose(fps)
    root = np.arange(len(fps))
    for shift in range(1, int(sizes[0])):
        a = near_lanes(planes, shift, int(ends[np.searchsorted(-sizes, -shift, "left") - 1]))
        a = a[a + shift < len(fps)]
        a = a[block[a] == block[a + shift]]
        root = _unite(root, a, a + shift)
    return _members(fps, root)


def large_links(fps: np.ndarray, queries: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large block: some members at a time against all later ones, leaving out the lanes
    that are in a member's class already, so a dense block is done after a few rounds."""
    planes = transpose(fps)[:, :-1]
    lanes, words = np.arange(planes.shape[1] * 64), planes.shape[1]
    signs = np.where(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") > 0, np.uint64(ALL), np.uint64(0))
    root = np.arange(len(fps))
    padded = np.full(len(lanes), -1)
    for at in range(0, len(fps), queries):
        mine = np.arange(at, min(at + queries, len(fps)))
        padded[: len(fps)] = root
        ask = (padded != root[mine][:, None]) & (lanes > mine[:, None])
        ask[:, len(fps) :] = False
        over = ~np.packbits(ask, axis=1, bitorder="little").view(np.uint64).ravel()
        alive, over = _count(planes, over, lambda b, x: planes[b][x % words] ^ signs[mine[x // words], b])
        i, lane = _open_bits(over)
        root = _unite(root, mine[alive[i] // words], alive[i] % words * 64 + lane)
    return _members(fps, root)


LARGE = 512


def block_links(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    parts = [large_links(b) for b in blocks if len(b) >= LARGE]
    if small := [b for b in blocks if 1 < len(b) < LARGE]:
        parts.append(small_links(small))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in parts)]), np.concatenate([none, *(b for _, b in parts)])


LANES = 1 << 16


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    lanes = 0

    def flush() -> pa.RecordBatch:
        a, b = block_links(held)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for start, end in zip(offsets[:-1], offsets[1:]):
            held.append(flat[start:end])
            lanes += end - start
            if lanes >= LANES:
                yield flush()
                held, lanes = [], 0
    if held:
        yield flush()


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: star links that join all distinct fingerprints (column ``fp``) of a class."""
    masks = [0]
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found = None
    while True:
        rows = _cut(rows, sorted(masks))
        masks = {m | q for m in masks for q in quarters(m)}
        key = ["mask", "value"]
        keyed = rows.withColumn("value", F.expr("fp & mask"))
        closed = max(64 - bin(m).count("1") for m in masks) <= block.bit_length() - 1  # 2^r members at most
        small = keyed
        if not closed:
            hot = keep(keyed.groupBy(key).count().filter(F.col("count") > block).select(key), "simhash-hot")
            masks = [r["mask"] % (1 << 64) for r in hot.select("mask").distinct().collect()]  # at most as many as the level has
            closed = not masks
            if not closed:
                small = keyed.join(hot, key, "left_anti")
                rows = keep(keyed.join(hot, key, "left_semi").select("fp", "mask"), "simhash-cut")
        groups = small.groupBy(key).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
        part = groups.mapInArrow(_compare, "a long, b long")
        found = part if found is None else found.union(part)
        if closed:
            return found


# ---------------------------------------------------------------- classes


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (child, parent), child > parent: every larger (or smaller and equal)
    neighbour of a node is linked to the least of its neighbourhood."""
    if large:
        sides = edges.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(edges.select("parent", "child"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = sides.filter("v > u").join(least, "u").select(F.col("v").alias("child"), F.col("m").alias("parent"))
    else:
        least = edges.groupBy(F.col("child").alias("u")).agg(F.min("parent").alias("m"))
        joined = edges.join(least, edges.child == least.u).select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        joined = joined.union(least.select(F.col("u"), F.col("m")))
    return joined.filter("child > parent").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its class for every node that has a link and is not that least one."""
    edges = edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).filter("child > parent").distinct()
    edges = keep(edges, "simhash-links")
    while True:
        ends = edges.select(F.col("child").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("parent", F.lit(0), F.lit(1))
        )
        odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
        if odd.isEmpty():
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        edges = keep(_star(_star(edges, True), False), "simhash-links")


def components(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fps`` (doc_id, fp and what else it has; cheap to read again) with component_id and root, a fingerprint of the class."""
    nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = classes(links(nodes, block))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = keep(placed, "simhash-placed")
    firsts = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.select("fp", "root").join(firsts, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id that links reach)."""
    fps = keep(fingerprints(docs, shingle), "simhash-fingerprints")
    return components(fps, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class: that of least id, then of least hash of the text, so unlike texts under one id
    stay both; of rows equal in id and text one stays.  Rows without an id stay."""
    fps = keep(fingerprints(docs.filter("doc_id IS NOT NULL")), "simhash-fingerprints")
    best = components(fps).groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("best"))
    own, doc_id, digest = fresh(docs, "__digest", "__best_id", "__best_digest")
    best = best.select(F.col("best.doc_id").alias(doc_id), F.col("best.digest").alias(digest))
    known = docs.withColumn(own, text_digest())
    kept = known.join(best, (F.col("doc_id").cast("long") == F.col(doc_id)) & (F.col(own) == F.col(digest)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
