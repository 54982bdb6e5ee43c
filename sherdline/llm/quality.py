"""Quality rules: counts over a text, and compression bands.

A text is compressed by zstandard as a whole and, if longer than a chunk, in fixed chunks, the last one
taken from the text's end.  The ratio (bytes before over bytes after) must lie in the band for its length:
prose lies in a narrow one, repetition goes above it, and noise such as encoded binary goes below it.
Longer texts compress better, so each length has its own band.  The upper limits lie five standard
deviations above the mean of documents labelled good, the lower ones four and a half below it up to 800
bytes and five and a half above that.  Base64 and random letters and digits go below at every length;
hexadecimal digits compress as short prose does and only go below in texts of over 3,200 bytes.

A null or empty text has no words, zero counts and fails the base rule.  Each row is judged alone, so
repeated rows and ids, null ids and empty tables need no rule of their own.
"""

from __future__ import annotations

from collections import Counter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

#: (bytes up to which the band holds, least ratio, greatest ratio)
BANDS = (
    (400, 1.27, 2.02), (560, 1.28, 2.12), (800, 1.38, 2.12), (1130, 1.49, 2.28), (1600, 1.66, 2.28), (3200, 1.75, 2.34),
    (6400, 1.92, 2.42), (12800, 2.05, 2.52), (25600, 2.09, 2.62), (float("inf"), 2.24, 2.75),
)
#: Chunks of a text of more than one; at most this share of its bytes may lie in chunks outside their band.
CHUNK = 4096
CHUNK_SHARE = 0.5
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words found twice or more, the first one included."""
    if len(set(zip(*(words[i:] for i in range(window))))) == max(0, len(words) - window + 1):
        return 0
    seen = Counter(zip(*(words[i:] for i in range(window))))
    total = covered = 0
    for i, key in enumerate(zip(*(words[i:] for i in range(window)))):
        if seen[key] > 1:
            total += i + window - max(covered, i)
            covered = i + window
    return total


def duplicate_lines(body: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in body.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def band(size: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if size <= most)


class Compression:
    """Ratios of whole texts and of their chunks; holds one compressor for a task."""

    def __init__(self, level: int = LEVEL):
        self.compressor = zstandard.ZstdCompressor(level=level)

    def ratio(self, body: bytes) -> float:
        return len(body) / len(self.compressor.compress(body))

    def within(self, body: bytes, bands=BANDS) -> tuple[bool, float]:
        low, high = band(len(body), bands)
        return low <= (ratio := self.ratio(body)) <= high, ratio

    def verdict(self, body: bytes, bands=BANDS, chunk: int = CHUNK, share: float = CHUNK_SHARE) -> tuple[bool, float, float]:
        """Whether the text passes, its ratio, and the share of its bytes in chunks outside their band."""
        if not body:
            return True, 1.0, 0.0
        passed, ratio = self.within(body, bands)
        odd = 0.0
        if len(body) > chunk:
            ends = [*range(chunk, len(body), chunk), len(body)]  # the last chunk reaches back over the one before
            new = [chunk] * (len(ends) - 1) + [len(body) - chunk * (len(ends) - 1)]
            odd = sum(n for end, n in zip(ends, new) if not self.within(body[end - chunk : end], bands)[0]) / len(body)
        return passed and odd <= share, ratio, odd


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, odd_chunks double"
)


def quality_rules(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, share: float = CHUNK_SHARE) -> DataFrame:
    """One row for each document: counts, ``base_failed``, ``kept``, and the compression figures."""

    def batch(rows: dict) -> dict:
        compression = Compression()
        out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        for doc_id, body in zip(rows["doc_id"], rows["body"]):
            words = body.split()
            repeats = repeated_words(words)
            text = body.decode()
            failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
            passed, ratio, odd = compression.verdict(body, bands, chunk, share)
            for name, value in zip(out, (
                doc_id, len(words), len(text) - sum(map(text.count, SPACE)), len(body) - len(body.translate(None, SYMBOLS)),
                duplicate_lines(body), repeats, failed, passed and not failed, ratio, odd,
            )):
                out[name].append(value)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), SCHEMA, batch)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, decided row by row without a join."""

    def decide(batches):
        import pyarrow as pa

        for batch in batches:
            compression = Compression()
            kept = []
            for body in batch.column(batch.schema.get_field_index("text")).to_pylist():
                body = (body or "").encode()
                words = body.split()
                kept.append(
                    len(words) >= MIN_WORDS and 100 * repeated_words(words) <= MAX_REPEAT_PERCENT * len(words) and compression.verdict(body)[0]
                )
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(decide, docs.schema)
