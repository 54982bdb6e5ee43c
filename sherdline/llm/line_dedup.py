"""Repeated passages by hashing of text units.

A text is tiled by units: a line is a unit, and a longer line is cut at its sentence ends, so that a passage
is met wherever it stands in a line; a sentence of fewer than ``UNIT_WORDS`` words goes with the next one.
A sentence of more than ``LONG`` words is cut after words whose checksum is a multiple of ``CUT``, so
that also a passage inside it is cut alike in every document.
A unit is normalised (ASCII letters lower-cased, white space runs as one space) and hashed to 128 bits.
Digests are grouped over all documents; the occurrence of least rank (document id, then place) stays and
all others are repeats.  A run of neighbouring repeats of ``RUN_WORDS`` words or more is removed; shorter
runs, such as a license line or a greeting, are left alone.

Grouping sums up per task before its shuffle, with one number a digest, so a unit that a third of all
documents share is no load; the join back is of plain columns, which Spark splits where a key is hot.
Units travel as numbers; texts are shuffled once, to meet the numbers of their repeated units.

A null text is an empty one (and comes out empty).  Rows with a null id rank last.  Rows that share an
id each keep the units whose first document they are.  Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, same

UNIT_WORDS = 4
LONG = 16
CUT = 4
RUN_WORDS = 20
LAST = (1 << 63) - 1
WORD = re.compile("[^ \\t\\n\\x0b\\x0c\\r]+")
BREAK = re.compile(r"\n|[.!?][\"')\]]*[ \t\r\f\v]+")


def units(text: str, least: int = UNIT_WORDS) -> list[tuple[int, int, int, int]]:
    """(start, end, words, 128-bit digest) of the units that tile the text; units without words have digest 0."""
    out = []

    def add(start: int, stop: int, words: list[bytes]) -> None:
        out.append((start, stop, len(words), xxhash.xxh3_128_intdigest(b" ".join(words)) if words else 0))

    start = 0
    stops = [(m.end(), text[m.start()] == "\n") for m in BREAK.finditer(text)]
    for stop, line_end in [*stops, (len(text), True)]:
        part = text[start:stop]
        words = part.encode().lower().split()
        if stop > start and (line_end or len(words) >= least):
            if len(words) <= LONG:
                add(start, stop, words)
            else:
                ends = [m.end() for m in WORD.finditer(part)]
                first, begin = 0, start
                for i in range(least - 1, len(words) - least):
                    if i + 1 - first >= least and not zlib.crc32(words[i]) % CUT:
                        add(begin, start + ends[i], words[first : i + 1])
                        first, begin = i + 1, start + ends[i]
                add(begin, stop, words[first:])
            start = stop
    return out


def unit_rows(docs: DataFrame, least: int = UNIT_WORDS) -> DataFrame:
    """high, low (the digest), doc_id (null: last), body (hash of the text), unit: one row for each unit with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = ["high", "low", "doc_id", "body", "unit"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, body, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for i, (_, _, words, digest) in enumerate(units(text, least)):
                    if words:
                        rows.append(((digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), doc_id, body, i))
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    text = F.coalesce("text", F.lit(""))
    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    return chosen.mapInArrow(run, "high long, low long, doc_id long, body long, unit int")


def repeated_units(docs: DataFrame, least: int = UNIT_WORDS) -> DataFrame:
    """doc_id, body, repeats: for each document the places of its units that occur more than once anywhere,
    negative (-1 - place) where the document is the first to hold the unit."""
    rows = unit_rows(docs, least)
    firsts = rows.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = keep(firsts, "repeated-units")  # as plain rows, so that Spark can split a hot digest in the join
    met = rows.join(firsts, ["high", "low"])
    place = F.when(F.col("doc_id") == F.col("first_doc"), -1 - F.col("unit")).otherwise(F.col("unit"))
    return met.select("doc_id", "body", place.alias("place")).groupBy("doc_id", "body").agg(F.collect_set("place").alias("repeats"))


def removals(text: str, repeats: list[int], least: int = UNIT_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Spans of the text to remove, in code points, end exclusive."""
    if not repeats:
        return []
    marks = set(repeats)
    seen: set[int] = set()
    spans: list[tuple[int, int]] = []
    begin, words = None, 0
    tiles = units(text, least)
    for i, (start, _, n, digest) in enumerate([*tiles, (len(text), len(text), 1, None)]):
        again = i in marks or -1 - i in marks and digest in seen
        if digest is not None and -1 - i in marks:
            seen.add(digest)
        if again or (begin is not None and not n):  # units without words go with the run
            begin = start if begin is None else begin
            words += n
        else:
            if begin is not None and words >= run_words:
                spans.append((begin, start))
            begin, words = None, 0
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def _with_repeats(docs: DataFrame, least: int) -> DataFrame:
    """The rows of ``docs`` with a last column of repeats."""
    own_id, own_body, doc_id, body, repeats = fresh(docs, "__id", "__body", "__of_id", "__of_body", "__repeats")
    found = repeated_units(docs, least).select(F.col("doc_id").alias(doc_id), F.col("body").alias(body), F.col("repeats").alias(repeats))
    keyed = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), own_body: F.xxhash64(F.coalesce("text", F.lit("")))})
    joined = keyed.join(found, same(F.col(own_id), F.col(doc_id)) & (F.col(own_body) == F.col(body)), "left")
    return joined.select(*docs.columns, repeats)


def dedup_lines(docs: DataFrame, least: int = UNIT_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_units, n_removed (spans), removed ("start:end" of each, comma-joined, in the original
    text), text (what is left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_units": [], "n_removed": [], "removed": [], "text": []}
            for text, repeats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = removals(text, repeats, least, run_words)
                out["n_units"].append(len(units(text, least)))
                out["n_removed"].append(len(spans))
                out["removed"].append(",".join(f"{a}:{b}" for a, b in spans))
                out["text"].append(without(text, spans))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string()), ("text", pa.string())])
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _with_repeats(chosen, least).mapInArrow(run, "doc_id long, n_units long, n_removed long, removed string, text string")


def cleaned(docs: DataFrame, least: int = UNIT_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` and ``n_chars`` counted anew; all rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                text and without(text, removals(text, repeats, least, run_words))
                for text, repeats in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            ]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = _with_repeats(docs, least).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
