import re

import numpy as np
import xxhash
from helpers import make_docs, rows_of

from sherdline.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    """The least index of each fingerprint's class, every pair compared."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[:i]) <= 3)[0]:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def near(rng, centre, most):
    x = int(centre)
    for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False):
        x ^= 1 << int(b)
    return x


def test_documents_against_all_pairs(documents):
    rows = sorted(documents.select("doc_id", "text").collect())
    fps = [plain_fingerprint(r.text) for r in rows]
    expected = sorted((r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, plain_classes(fps)))
    assert rows_of(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


def test_odd_documents(odd_docs, odd_rows):
    fps = [plain_fingerprint(t) for _, t in odd_rows]
    classes = plain_classes(fps)
    least = {c: min((i for (i, _), k in zip(odd_rows, classes) if k == c and i is not None), default=None) for c in classes}
    expected = sorted(((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(odd_rows, fps, classes)), key=repr)
    assert rows_of(simhash.near_duplicates(odd_docs), "doc_id", "fingerprint", "component_id") == expected


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).collect() == []


def test_hot_blocks_are_cut_until_small(spark):
    """A dense group far larger than a block: every cut is taken, no link is lost."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12)
    fps = sorted({near(rng, c, 6) for c in centres for _ in range(20)} | {near(rng, centres[0], 4) for _ in range(300)})
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.components(table, block=100).collect()}
    assert found == dict(enumerate(plain_classes(fps)))


def test_bit_sliced_blocks_against_all_pairs():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 1 << 63, 40)
    fps = np.array(sorted({near(rng, c, 5) for c in centres for _ in range(40)}), np.uint64)
    blocks = np.array_split(rng.permutation(fps), [2, 3, 66, 200, 800])
    links = list(zip(*simhash.block_links([b for b in blocks if len(b)])))
    for block in blocks:
        mine = {int(x): i for i, x in enumerate(block)}
        pairs = [(mine[int(a.view(np.uint64))], mine[int(b.view(np.uint64))]) for a, b in links if int(a.view(np.uint64)) in mine]
        assert len(pairs) < max(1, len(block))  # a star at most, never all pairs
        root = list(range(len(block)))
        for a, b in sorted(pairs, key=max):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        groups = lambda r: sorted(sorted(i for i in range(len(r)) if r[i] == k) for k in set(r))
        assert groups(root) == groups(plain_classes(block.tolist()))


def test_one_of_each_keeps_the_least_id(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = make_docs(spark, [(9, text), (2, text + " more"), (5, " ".join(f"other{i}" for i in range(200))), (2, text + " more"), (None, "no id")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(2,), (5,), (None,)]


def test_one_of_each_of_unlike_texts_under_one_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(200)) for w in ("word", "other"))
    docs = make_docs(spark, [(4, one), (4, two), (4, two), (7, one), (8, two)])
    kept = simhash.one_of_each(docs.withColumn("__kept", docs["fp"]).withColumn("__Digest", docs["fp"]).withColumn("__best_id", docs["n_chars"]))
    assert rows_of(kept, "doc_id", "text") == sorted([(4, one), (4, two)], key=repr)
    assert kept.columns[-3:] == ["__kept", "__Digest", "__best_id"]
