import base64
import os
import random
import re
import string

import zstandard
from helpers import make_docs, rows_of

from sherdline.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def verdict(text):
    body = (text or "").encode()
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b))
    fits = lambda b: next(low <= ratio(b) <= high for most, low, high in quality.BANDS if len(b) <= most)
    if not body:
        return True
    whole = [body[i : i + quality.CHUNK] for i in range(0, len(body) - quality.CHUNK + 1, quality.CHUNK)] if len(body) >= 2 * quality.CHUNK else []
    return fits(body) and (not whole or sum(not fits(c) for c in whole) <= quality.CHUNK_SHARE * len(whole))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def expected(rows):
    return sorted(((i, *plain(t), verdict(t) and not plain(t)[-1]) for i, t in rows), key=repr)


def test_documents_against_plain(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(quality.quality_rules(documents), *COLUMNS) == expected(rows)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    assert rows_of(quality.quality_rules(odd_docs), *COLUMNS) == expected(odd_rows)
    assert quality.quality_rules(no_docs).collect() == [] == quality.keep_good(no_docs).collect()


def test_keep_good_agrees_with_the_rules(documents, odd_docs):
    for docs in (documents, odd_docs):
        kept = quality.keep_good(docs)
        assert kept.schema == docs.schema
        assert rows_of(kept, "doc_id") == rows_of(quality.quality_rules(docs).filter("kept"), "doc_id")


def test_labelled_good_documents_stay(spark):
    """Of the good documents that pass the base rule nearly all are kept; a fifth of the junk that passes it goes."""
    folder = "/root/testdata/sf0.1"
    judged = quality.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.002 * counts[1, True]
    assert counts.get((0, False), 0) >= 0.2 * (counts.get((0, True), 0) + counts[0, False])


def test_bands_reject_repetition_and_noise():
    rules = quality.Compression()
    noise = os.urandom(9000)
    assert not rules.verdict(b"the same words again and again. " * 300)[0]
    assert not rules.verdict(noise)[0]
    prose = " ".join(str(hash(("w", i)) % 10**6) + "ing" for i in range(30)).encode()
    assert rules.verdict(prose)[0]
    passed, _, odd = rules.verdict(prose * 1 + noise, share=0.5)
    assert not passed and odd == 1.0


def test_repeated_words():
    assert quality.repeated_words(b"a b c a b c".split()) == 6
    assert quality.repeated_words(b"x a b c y a b c z".split()) == 6
    assert quality.repeated_words(b"a a a a".split()) == 4
    assert quality.repeated_words(b"a b".split()) == quality.repeated_words([]) == 0


def test_bands_reject_encoded_text():
    rules = quality.Compression()
    rng = random.Random(8)
    parts = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    for size in (390, 500, 560, 600, 780, 1000, 1500, 3100, 6300, 12_700, 25_000, 100_000):
        coded = base64.b64encode(rng.randbytes(size)).decode()
        made = [" ".join(parts(coded, 7)), "\n".join(parts(coded, 76)), " ".join(parts("".join(rng.choices(string.ascii_letters + string.digits, k=size)), 6))]
        made += [" ".join(parts(rng.randbytes(size).hex(), 8))] if size > 3200 else []
        for text in made:
            assert not rules.verdict(text[:size].encode())[0], (size, text[:40])


def test_tails_and_texts_of_two_chunks_are_judged():
    rules = quality.Compression()
    noise = base64.b64encode(random.Random(9).randbytes(9000))
    anything = ((float("inf"), 1.9, 1e9),)
    prose = b"the words of this line come again and again " * 400
    assert rules.verdict(prose[:4096] + noise[:3000], anything)[2] > 0.4
    assert rules.verdict(prose[:8192] + noise[:4095], anything)[2] > 0.3
    assert rules.verdict(prose[:4096] + noise[:3000], anything, chunk=1000, share=0.4)[0] is False
