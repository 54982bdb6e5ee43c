"""Byte-level BPE by a queue of merge ranks over a linked list of symbols.

A text is cut at the tokenizer's added strings, then into words by its pattern; a word's symbols form a
doubly linked list, all adjacent pairs that merge stand in a priority queue by (rank, place), and a
popped entry whose symbols have changed since is skipped.  Decoding joins vocabulary byte strings.
Words recur, so each task keeps the ids of the words it met last, up to ``HELD`` of them; the
vocabulary file is read once in a task's process.  Nothing is shuffled.

A null text is an empty one: no tokens, the hashes of nothing.  Rows are independent: null and
repeated ids stay as they are, an empty table gives no rows, a text of any length is held by its task
alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

HELD = 800_000
#: White space of the Unicode standard, which the patterns below mean by \s.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word with the space before it, or white space on its own.
UNIT = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Fixed value: the published pattern that cuts a unit further.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def latin_class(kind: str, most: int = 0x240) -> str:
    """The characters below ``most`` of a general category, as the inside of a bracket."""
    return "".join(re.escape(chr(c)) for c in range(most) if unicodedata.category(chr(c))[0] == kind)


#: The same pattern for texts below U+0240, where the classes can be spelled out for the faster engine.
LETTER, NUMBER = latin_class("L"), latin_class("N")
LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{WS}{LETTER}{NUMBER}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: UTF-8 lead bytes up to this one are of code points below U+0240.
LATIN_LEAD = 0xC8


def is_latin(body: bytes) -> bool:
    return not body or int(np.frombuffer(body, np.uint8).max()) <= LATIN_LEAD


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others in order for the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Bpe:
    """A byte-level vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, path: str, held: int = HELD):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        back = {ord(c): b for b, c in letters.items()}
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: adjacent ids in one number -> rank and merged id in one number
        self.pairs = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.first = [self.vocab[letters[b]] for b in range(256)]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: s.encode() for s, i in added.items()}
        self.strings.update({i: bytes(back[ord(c)] for c in s) for s, i in self.vocab.items() if i not in self.strings})
        self.added = {s: np.uint32(i).tobytes() for s, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.held, self.known = held, {}

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word of the pattern."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        merge = self.pairs.get
        queue = []  # rank, merged id and place in one number, which orders by rank, then place
        last = ids[0]
        for i in range(1, n):
            here = ids[i]
            if (found := merge(last << 20 | here)) is not None:
                queue.append(found << 32 | i - 1)
            last = here
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # n stands for the end
        while queue:
            entry = heapq.heappop(queue)
            i, found = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j == n or ids[i] < 0 or merge(ids[i] << 20 | ids[j]) != found:
                continue  # stale
            ids[i] = made = found & 0xFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := merge(made << 20 | ids[k])) is not None:
                    heapq.heappush(queue, found << 32 | i)
            if (h := before[i]) >= 0 and (found := merge(ids[h] << 20 | made)) is not None:
                heapq.heappush(queue, found << 32 | h)
        return [x for x in ids if x >= 0]

    def __missing(self, word: str) -> bytes:
        ids = self.word_ids(word.encode())
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:  # longer ones hardly recur, and their size has no bound
            if len(self.known) >= self.held:
                self.known.clear()
            self.known[word] = got
        return got

    def plain(self, text: str) -> bytes:
        """Ids of a text without added strings."""
        words = LATIN_WORD.findall(text) if is_latin(text.encode()) else [w for unit in UNIT.findall(text) for w in WORD.findall(unit)]
        known = self.known.get
        return b"".join([known(w) or self.__missing(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.added):
            return self.plain(text)
        return b"".join(self.added[part] if k % 2 else self.plain(part) for k, part in enumerate(self.cut.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded: every whole text encoded and decoded again."""

    def batch(rows: dict) -> dict:
        bpe = load(path)
        ids = [bpe.encode(b.decode()) for b in rows["body"]]
        return {"doc_id": rows["doc_id"], "ids": [np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in ids], "decoded": [bpe.decode(x) for x in ids]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), "doc_id long, ids array<int>, decoded string", batch)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without carrying ids or texts out of the task."""

    def batch(rows: dict) -> dict:
        bpe = load(path)
        out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for body in rows["body"]:
            ids = bpe.encode(body.decode())
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), schema, batch)
