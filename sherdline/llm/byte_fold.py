"""Byte-level BPE as a fold of ranked merges, by Spark's higher-order functions over the bytes of distinct words.

Texts are cut into words by the vocabulary's pattern in the JVM.  A task brings the words of some documents
together (``TOGETHER`` of them, or one longer document) as a dictionary and the documents' places in it,
so that a word is merged once for all of them and found by its index; nothing is shuffled.  Words that are
frequent in a bounded sample of documents are merged before, ``KNOWN`` of at most ``SHORT`` bytes, and sent
to the tasks; which ones changes nothing but the time.

Bytes are written as the characters U+0000 to U+00FF, which Spark's strings hold, and pieces of several
bytes as one character each from ``PIECE`` on.  All stretches of a word that are pieces of the vocabulary
are its candidate merges, found in a literal rank map; ``aggregate`` folds them over the word in the order
of their ranks, each replacing its two parts by the piece wherever they stand side by side.  That is byte-pair
encoding, because a piece made of two parts always ranks after both.  The literal is an array of small maps
dealt by CRC-32, as Spark looks for a key by walking its map.  Decoding looks up the pieces of ids in a
literal array and joins them.

The candidates of a word grow with the square of its length, so words of more than ``LONG`` bytes (encoded
data, one letter repeated) are merged beside the fold, by a queue over a linked list, while the dictionary is
made.  ``pattern`` is read with Unicode classes, to which letters and numbers that are younger than the
JVM's own tables are added.

A null or empty text has no ids and decodes to nothing.  Rows are independent: null and repeated ids stay
as they are, an empty table gives no rows.  Other columns are not read.  A vocabulary that lacks single
bytes, or has a piece that no two others make, is an error.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes

TOGETHER = 1 << 21
KNOWN, SHORT, SAMPLE = 1 << 18, 32, 20_000
LONG = 256
#: Maps that the ranks are dealt over; two ranks in each or fewer.
MAPS = 1 << 15
PIECE = 0x10000
#: Bytes whose entry also says how long the longest piece is that begins with them.
HEAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a piece in base64 and its rank on every line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return ranks


def two_parts(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two pieces that a piece is made of: what the merges before it leave of its bytes."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[piece]:
            raise ValueError(f"no two pieces make {piece!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def literal(value: list, kind: str) -> Column:
    """A constant of any size as one literal of the plan, without an expression for every element."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """By piece of several bytes: its rank, its two parts and the piece as characters; and by ``HEAD`` bytes the
    length of the longest piece that begins with them."""

    def character(piece: bytes) -> str:
        return piece.decode("latin-1") if len(piece) == 1 else chr(PIECE + ranks[piece])

    entries: dict[bytes, dict] = defaultdict(dict)
    for piece, rank in ranks.items():
        if len(piece) > 1:
            entries[piece] |= {"rank": rank, "parts": "".join(map(character, two_parts(piece, ranks))), "piece": character(piece)}
        if len(piece) >= HEAD:
            entries[piece[:HEAD]]["longest"] = max(len(piece), entries[piece[:HEAD]].get("longest", 0))
    maps: list[dict] = [{} for _ in range(MAPS)]
    for piece, entry in entries.items():
        text = piece.decode("latin-1")
        maps[zlib.crc32(text.encode()) % MAPS][text] = entry
    return literal(maps, "array<map<string,struct<rank:int,parts:string,piece:string,longest:int>>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made, or a literal that is held, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, maps: Column, single: Column) -> Column:
    """Ids of a word by a ``rank_map`` and the array of the ids of single bytes."""

    def merge(text: Column) -> Column:
        return F.get(maps, (F.crc32(text.cast("binary")) % MAPS).cast("int"))[text]

    def merges(word: Column) -> Column:
        starts = F.when(F.length(word) > 1, F.sequence(F.lit(0), F.length(word) - 2))  # null for a single byte
        longest = lambda i: F.coalesce(merge(F.substring(word, i + 1, F.lit(HEAD)))["longest"], F.lit(HEAD - 1))
        lengths = lambda i: F.sequence(F.lit(2), F.least(F.length(word) - i, longest(i)))
        stretches = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.transform(lengths(i), lambda n: merge(F.substring(word, i + 1, n))))
        return F.sort_array(F.filter(F.flatten(stretches), lambda m: m["rank"].isNotNull()))

    def ids(word: Column) -> Column:
        pieces = F.aggregate(merges(word), word, lambda state, m: F.replace(state, m["parts"], m["piece"]))
        return F.transform(F.split(pieces, ""), lambda c: F.when(F.ascii(c) < PIECE, F.get(single, F.ascii(c))).otherwise(F.ascii(c) - PIECE))

    return let(F.decode(word.cast("binary"), "ISO-8859-1"), ids)


def queue_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: pairs wait by rank and place; one whose parts have changed since is skipped."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a byte; 0 once merged away
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)

    def offer(i: int, j: int) -> None:
        if (rank := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(waiting, (rank, i, ends[j]))

    while waiting:
        _, i, end = heapq.heappop(waiting)
        j = ends[i]
        if not j or j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        if end < n:
            before[end] = i
            offer(i, end)
        if before[i] >= 0:
            offer(before[i], i)
    return [ranks[word[i:end]] for i, end in enumerate(ends) if end]


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for the JVM, whose letters and numbers are completed to those of the regex module."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind in (r"\p{L}", r"\p{N}"):
        of_kind = "".join(regex.findall(kind, every))
        missing = spark.range(1).select(F.regexp_replace(F.lit(of_kind), kind, "")).first()[0]
        codes = set(map(ord, missing))
        if codes:
            starts, ends = sorted(c for c in codes if c - 1 not in codes), sorted(c for c in codes if c + 1 not in codes)
            ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends))
            pattern = pattern.replace(kind, f"[{kind}[\\x{{{starts[0]:X}}}-\\x{{10FFFF}}&&[{ranges}]]]")  # older characters fail the first test
    return "(?U)" + pattern


def known_words(words: DataFrame, ids: Callable[[Column], Column]) -> pa.Table:
    """word, ids of frequent words: those met twice or more in a sample of ``SAMPLE`` documents, the most frequent ``KNOWN``."""
    share = min(1.0, SAMPLE / max(1, words.count()))
    word = F.col("word")
    counts = words.sample(share, seed=1).select(F.explode("words").alias("word")).filter(F.octet_length(word) <= SHORT).groupBy("word").count()
    frequent = counts.filter("count > 1").orderBy(F.desc("count"), "word").limit(KNOWN).select("word")
    tasks = words.sparkSession.sparkContext.defaultParallelism  # the rows are few, their work is not
    return frequent.repartition(tasks, "word").select("word", ids(word).alias("ids")).toArrow()


def dictionaries(words: DataFrame, known: pa.Table, ranks: dict[bytes, int], together: int) -> DataFrame:
    """docs, words: documents with the places of their words among the distinct words; known and long words come with their ids."""
    shared = words.sparkSession.sparkContext.broadcast((known.combine_chunks(), ranks))
    one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

    def some(doc_ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        known, ranks = shared.value
        found = lists.flatten().dictionary_encode()
        offsets = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int32))
        docs = pa.StructArray.from_arrays([doc_ids, pa.ListArray.from_arrays(offsets, found.indices)], names=["doc_id", "places"])
        distinct = found.dictionary
        given = pa.chunked_array([known["ids"].combine_chunks().take(pc.index_in(distinct, known["word"].combine_chunks()))]).combine_chunks()
        long = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) > LONG)
        if len(long):
            given = given.to_pylist()
            for i in long.tolist():
                given[i] = queue_ids(distinct[i].as_py().encode(), ranks)
            given = pa.array(given, pa.list_(pa.int32()))
        entries = pa.StructArray.from_arrays([distinct, given], names=["word", "given"])
        return pa.RecordBatch.from_arrays([one(docs), one(entries)], names=["docs", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, lists = batch.columns
            counts = np.cumsum(pc.list_value_length(lists).to_numpy())
            start = 0
            while start < len(doc_ids):
                done = counts[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(counts, done + together, "right")))
                yield some(doc_ids.slice(start, stop - start), lists.slice(start, stop - start))
                start = stop

    return words.mapInArrow(run, "docs array<struct<doc_id:long,places:array<int>>>, words array<struct<word:string,given:array<int>>>")


def encode(docs: DataFrame, path: str, pattern: str, together: int = TOGETHER) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""
    ranks = read_ranks(path)
    constants = F.struct(rank_map(ranks).alias("maps"), literal([ranks[bytes([b])] for b in range(256)], "array<int>").alias("single"))
    body = text_bytes().cast("string")
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(body, F.lit(jvm_pattern(docs.sparkSession, pattern)), F.lit(0)).alias("words"))
    known = known_words(words, lambda word: let(constants, lambda c: folded(word, c["maps"], c["single"])))
    ids = let(constants, lambda c: F.transform("words", lambda w: F.coalesce(w["given"], folded(w["word"], c["maps"], c["single"]))))
    made = dictionaries(words, known, ranks, together).select("docs", F.explode(F.array(ids)).alias("ids"))  # behind an explode, so that it is made once
    rows = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), F.flatten(F.transform(d["places"], lambda i: F.get("ids", i))).alias("ids")))
    return made.select(F.inline(rows))


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids stand for."""
    pieces = {rank: piece.decode("latin-1") for piece, rank in read_ranks(path).items()}
    by_id = literal([pieces.get(i) for i in range(max(pieces) + 1)], "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(by_id, i)), ""), "ISO-8859-1")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.col("ids")
    return encode(docs, path, pattern).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoded(ids, path), 256).alias("decoded_sha256"),
    )
