import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import make_docs, rows_of

from sherdline.llm import byte_fold

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = [
    "a", "B", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "é", "Σ", "İ", "ß", "9", "٣", "½", "<|endoftext|>", "🎉", "日本",
    "-", "...", "the", "ing", "\r", "\x00", "_", "ʼ", "tion", "erha", "aaaa", "ᲀ", "𞤀", "Ꟁ",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_fold.read_ranks(PATH), special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_token_digests(odd_docs, odd_rows, no_docs, documents, library):
    assert rows_of(byte_fold.token_digests(odd_docs, PATH, PATTERN), *COLUMNS) == expected(library, odd_rows)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(byte_fold.token_digests(documents, PATH, PATTERN), *COLUMNS) == expected(library, rows)
    assert byte_fold.token_digests(no_docs, PATH, PATTERN).collect() == []


def test_random_texts_in_small_dictionaries(spark, library, monkeypatch):
    monkeypatch.setattr(byte_fold, "SAMPLE", 50)
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 30)))) for i in range(1500)]
    rows += [(2000 + i, "".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0x1100, 0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(30))) for i in range(300)]
    coded = byte_fold.encode(make_docs(spark, rows).repartition(2), PATH, PATTERN, together=200)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {i: library.encode_ordinary(text) for i, text in rows}


def test_decoding_gives_the_bytes_back(spark, library):
    rows = [(1, "the thing é🎉"), (2, None)]
    coded = byte_fold.encode(make_docs(spark, rows), PATH, PATTERN)
    got = {r.doc_id: (list(r.ids), bytes(r.text)) for r in coded.select("doc_id", "ids", byte_fold.decoded(coded["ids"], PATH).alias("text")).collect()}
    assert got == {1: (library.encode_ordinary(rows[0][1]), rows[0][1].encode()), 2: ([], b"")}


@pytest.mark.parametrize("word", ["ab" * 5000, "a" * 3000, "".join(random.Random(2).choices("abcdeéz", k=5000)), "x"])
def test_queue_of_long_words(library, word):
    assert byte_fold.queue_ids(word.encode(), byte_fold.read_ranks(PATH)) == library._core_bpe.encode_single_piece(word.encode())


def test_vocabulary_that_merges_cannot_make(tmp_path):
    with pytest.raises(ValueError, match="no two pieces"):
        byte_fold.two_parts(b"abc", {b"a": 0, b"b": 1, b"c": 2, b"abc": 3})
    (tmp_path / "short").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_fold.read_ranks(str(tmp_path / "short"))
