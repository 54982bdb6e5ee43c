"""Packing documents into sequences by minimum bin slack.

A document's ids (with the closing id) are cut into whole sequences of ``WINDOW`` ids and a remainder.
Remainders wait in a pool of ``POOL`` lengths; each sequence takes the longest one and then the multiset
of waiting lengths whose sum comes closest to the window.  Reachable sums are the bits of one integer:
a length with k copies is or-ed in as shifted copies in the binary parts of k, and the integer after
every step is kept, so the chosen counts are traced back.  Slack that no multiset fills is filled by
cutting one more remainder.  When a task's documents end, its pool is emptied the same way and the last
ids, fewer than a window, are cut into powers of two, which need no padding.

Each task packs its own documents, so nothing is shuffled, memory is bounded by the pool, and a task that
runs again gives the same pieces.  Sequence ids are the task's number, then its count of sequences.

A null or empty text has the closing id alone.  Null and repeated ids pass through: a row is a document
of its own.  Texts of any length are cut as they come; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, WS, is_latin
from .common import text_bytes

WINDOW = 2048
POOL = 256
END = 1
HELD = 800_000
TOGETHER = 128
#: The vocabulary's own pattern (fixed value) for lower-cased texts below U+0240, its classes spelled out.
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{WS}{LETTER}{NUMBER}]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words:
    """Ids by the tokenizers library.

    The vocabulary drops white space and treats the words between alone, so the ids of words met before
    are kept, up to ``held`` of them, and only new words go to the library, many in one call.  Texts
    that lie below U+0240 once lower-cased are cut by the vocabulary's own pattern; each such word ends
    in a token that carries the end mark, which tells the words of a call apart (where it does not, each
    word is a call's text of its own).  Other texts, and those with an added string, are cut at ASCII
    white space and the library does the rest.
    """

    def __init__(self, path: str, held: int = HELD):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]), bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(mark)]] = True
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.held, self.known, self.units = held, {}, {}

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            (got,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            cuts = [0, *(np.nonzero(self.ends[ids])[0] + 1).tolist()]
            if len(cuts) != len(some) + 1 or cuts[-1] != len(ids):
                for word, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                    self.known[word] = np.array(got.ids, "<u4").tobytes()
                continue
            raw = ids.tobytes()
            for word, a, b in zip(some, cuts, cuts[1:]):
                self.known[word] = raw[4 * a : 4 * b]

    def ids(self, body: bytes) -> bytes:
        return self.ids_of([body])[0]

    def ids_of(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of several texts, their new words learnt together."""
        cut: list[list[str] | None] = []
        for body in bodies:
            text = body.decode()
            lower = text.lower()  # the pattern's classes must hold what lower-casing gives
            cut.append(LATIN.findall(lower) if is_latin(lower.encode()) and not any(a in text or a in lower for a in self.added) else None)
        if len(self.known) >= self.held:
            self.known.clear()
        new = set().union(*(words for words in cut if words)).difference(self.known)
        self.learn(list(new))
        known = self.known.__getitem__
        out = [self.other(body) if words is None else b"".join(map(known, words)) for body, words in zip(bodies, cut)]
        for word in new:
            if len(word) > 64:
                del self.known[word]
        return out

    def other(self, body: bytes) -> bytes:
        units = body.split()  # ASCII white space only
        if len(self.units) >= self.held // 8:
            self.units.clear()
        new = [w for w in set(units) if w not in self.units]
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            for word, got in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                self.units[word] = np.array(got.ids, "<u4").tobytes()
        out = b"".join(map(self.units.__getitem__, units))
        for word in new:
            if len(word) > 64:
                del self.units[word]
        return out


@lru_cache(2)
def load(path: str) -> Words:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path)


def closest_fill(lengths: Counter, room: int) -> Counter:
    """The counts of lengths whose sum is the greatest that does not exceed ``room``."""
    within = (1 << room + 1) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # reachable sums before the step, length, copies taken together
    for length, copies in sorted(lengths.items(), reverse=True):
        part = 1
        while copies and not reach >> room & 1:
            take = min(part, copies)
            steps.append((reach, length, take))
            reach |= reach << length * take & within
            copies -= take
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: Counter = Counter()
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= length * take
    return chosen


class Packer:
    """Packs the documents of one task; pieces come out as rows of ``SCHEMA``."""

    def __init__(self, task: int, window: int = WINDOW, pool: int = POOL):
        self.window, self.pool = window, pool
        self.next_id = task << 40
        self.waiting: dict[int, deque] = {}
        self.lengths: Counter = Counter()
        self.count = 0
        self.rows: list[tuple] = []

    def piece(self, item: tuple, offset: int) -> None:
        doc_id, start, ids, tokens = item
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next_id, offset))

    def hold(self, item: tuple) -> None:
        length = len(item[2]) // 4
        self.waiting.setdefault(length, deque()).append(item)
        self.lengths[length] += 1
        self.count += 1

    def take(self, length: int) -> tuple:
        self.lengths[length] -= 1
        self.count -= 1
        item = self.waiting[length].popleft()
        if not self.lengths[length]:
            del self.lengths[length], self.waiting[length]
        return item

    @staticmethod
    def cut(item: tuple, at: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, tokens = item
        return (doc_id, start, ids[: 4 * at], tokens), (doc_id, start + at, ids[4 * at :], tokens)

    def add(self, doc_id, ids: bytes) -> None:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.window
        for start in range(0, whole, self.window):
            self.piece((doc_id, start, ids[4 * start : 4 * (start + self.window)], tokens), 0)
            self.next_id += 1
        if whole < tokens:
            self.hold((doc_id, whole, ids[4 * whole :], tokens))
            while self.count >= self.pool:
                self.emit()

    def emit(self) -> None:
        """One full sequence; the pool must hold at least a window of ids."""
        items = [self.take(max(self.lengths))]
        room = self.window - len(items[0][2]) // 4
        for length, copies in closest_fill(self.lengths, room).items():
            items += [self.take(length) for _ in range(copies)]
            room -= length * copies
        if room:  # then every waiting length is greater than the slack
            head, rest = self.cut(self.take(min(self.lengths)), room)
            items.append(head)
            self.hold(rest)
        self.lay(items)

    def lay(self, items: list[tuple]) -> None:
        offset = 0
        for item in items:
            self.piece(item, offset)
            offset += len(item[2]) // 4
        self.next_id += 1

    def finish(self) -> None:
        while (total := sum(k * v for k, v in self.lengths.items())) >= self.window:
            self.emit()
        left = deque(self.take(n) for n in sorted(self.lengths.elements(), reverse=True))
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            room, items = 1 << bit, []
            while room:
                item = left.popleft()
                if len(item[2]) // 4 > room:
                    item, rest = self.cut(item, room)
                    left.appendleft(rest)
                items.append(item)
                room -= len(item[2]) // 4
            self.lay(items)


def pack(docs: DataFrame, path: str, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """One row for each piece; ``path`` names the vocabulary file of the tokenizers library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        end = np.uint32(END).tobytes()
        packer = Packer(TaskContext.get().partitionId(), window, pool)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            doc_ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(bodies), TOGETHER):
                for doc_id, ids in zip(doc_ids[at : at + TOGETHER], words.ids_of(bodies[at : at + TOGETHER])):
                    packer.add(doc_id, ids + end)
                if len(packer.rows) >= 10_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, SCHEMA)
