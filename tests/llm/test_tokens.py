import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import make_docs, rows_of
from tokenizers import Tokenizer

from sherdline.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "B", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", "é", "é", "Σ", "ΑΣ", "İ", "ſ", "ß", "9", "٣", "½", "²",
    "<|endoftext|>", "<|startoftext|>", "🎉", "日本", "-", "...", "the", "ing", "\r", "\x00", "﻿", "Ⅷ", "ǅ", "𝔸", "_", "ʼ", "ȿ", "ʰ", "tion",
]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)]


def test_bpe_equals_the_library():
    library, mine = Tokenizer.from_file(BYTES), bpe.Bpe(BYTES, held=500)
    for text in texts(4000, 1):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids, repr(text)
        assert mine.decode(mine.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_merges_one_long_word():
    library, mine = Tokenizer.from_file(BYTES), bpe.Bpe(BYTES)
    rng = random.Random(2)
    for word in ("ab" * 20_000, "".join(rng.choices("abcdeéz", k=20_000))):
        assert np.frombuffer(mine.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_word_ids_equal_the_library():
    library, mine = Tokenizer.from_file(WORDS), packing.Words(WORDS, held=300)
    for text in texts(4000, 3):
        assert np.frombuffer(mine.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_ids_of_every_character_below_0250():
    library, mine = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    for c in map(chr, range(0x250)):
        for text in (f"ab{c}cd", f"{c}x {c}-", f"A{c}", f"{c}{c.upper()}1", f"{c}-"):
            assert np.frombuffer(mine.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(chr(rng.randrange(0x250)) if rng.random() < 0.5 else rng.choice("ab '.sS1-ƏƐ") for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(mine.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_that_the_end_marks_do_not_tell_apart():
    library, mine = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    mine.learn(["two-words", "one"])  # the first is two words to the library
    assert np.frombuffer(mine.known["two-words"], "<u4").tolist() == library.encode("two-words", add_special_tokens=False).ids
    assert np.frombuffer(mine.known["one"], "<u4").tolist() == library.encode("one", add_special_tokens=False).ids


def test_token_digests(odd_docs, odd_rows, no_docs, documents):
    library = Tokenizer.from_file(BYTES)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def expected(rows):
        out = []
        for doc_id, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            out.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
        return sorted(out, key=repr)

    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(bpe.token_digests(odd_docs, BYTES), *columns) == expected(odd_rows)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(bpe.token_digests(documents, BYTES), *columns) == expected(rows)
    assert bpe.token_digests(no_docs, BYTES).collect() == []


def test_encode_documents_gives_ids_and_texts(spark):
    row = bpe.encode_documents(make_docs(spark, [(1, "the thing"), (2, None)]), BYTES).orderBy("doc_id").collect()
    assert row[0].ids == Tokenizer.from_file(BYTES).encode("the thing").ids and row[0].decoded == "the thing"
    assert row[1].ids == [] and row[1].decoded == ""


def assert_packed(pieces, rows):
    """Every id of every document in exactly one piece, and sequences without gaps or needless padding."""
    library = Tokenizer.from_file(WORDS)
    left: dict = {}
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        left.setdefault(i, []).append(ids)
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert sum(p.length for p in pieces) == sum(len(ids) for group in left.values() for ids in group)
    for (doc_id, tokens), mine in by_doc.items():
        fits = [ids for ids in left[doc_id] if len(ids) == tokens]
        assert fits
        for p in mine:
            assert any(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in fits)
        assert sorted(x for p in mine for x in range(p.start, p.start + p.length)) == sorted([*range(tokens)] * len(fits))
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0  # whole, or a power of two


def test_packing(odd_docs, odd_rows, no_docs, documents):
    assert_packed(packing.pack(odd_docs, WORDS).collect(), odd_rows)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert_packed(packing.pack(documents.repartition(3), WORDS).collect(), rows)
    assert packing.pack(no_docs, WORDS).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_closest_fill_against_all_subsets(seed):
    rng = random.Random(seed)
    lengths = packing.Counter(rng.choices(range(1, 40), k=rng.randint(0, 10)))
    room = rng.randint(0, 90)
    sums = {0}
    for n in lengths.elements():
        sums |= {s + n for s in sums if s + n <= room}
    chosen = packing.closest_fill(lengths, room)
    assert sum(n * k for n, k in chosen.items()) == max(sums) and all(k <= lengths[n] for n, k in chosen.items())
