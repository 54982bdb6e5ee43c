import hashlib
import random

import numpy as np
import pytest
from helpers import SMALL

from sherdline.llm import part_codes
from sherdline.plans.check import connect, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, ints string, place string, part string, n string, code string, of string"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def brute(rows):
    """All distances of all rounds, in Python's integers."""
    floor = lambda x: int(np.floor(float(np.float32(x)) * 1024))
    good = [(i, [floor(x) for x in v], label) for i, v, label in rows if v and len(v) % 4 == 0 and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    w = len(good[0][1]) // 4
    books = [[r[1][p * w : p * w + w] for r in good[:256]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            mine = {}
            for _, v, _ in good:
                part = v[p * w : p * w + w]
                mine.setdefault(near(part, books[p])[1], []).append(part)
            for k, group in mine.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, totals = [], {}
    for i, v, label in good:
        best = [near(v[p * w : p * w + w], books[p]) for p in range(4)]
        error = sum(b[0] for b in best)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{b[1]:02x}" for b in best), error, label))
    return sorted(((i, code, error, totals[label], sha) for i, code, error, label in out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,n,d", [(1, 40, 8), (2, 330, 4), (3, 300, 12)])
def test_against_brute_force(spark, seed, n, d):
    rng = random.Random(seed)
    grid = [x / 2048 for x in range(-9, 9)]  # few values: shared prefixes and ties
    rows = [(rng.randrange(n), [rng.choice(grid) for _ in range(d)], rng.choice([1, 2, None])) for _ in range(n)]
    rows += [rows[0]] * (n // 2)  # a third of the rows are copies
    rows += [(None, rows[1][1], 2), (1, None, 1), (2, [], 1), (3, [float("nan")] * d, 1), (4, [float("inf")] + [0.0] * (d - 1), 1), (5, [None] + [0.0] * (d - 1), 1), (10**6, [0.0] * 2 * d, 1), (10**6, [1.0], 1)]
    assert got(part_codes.part_codes(frame(spark, rows).repartition(3))) == brute(rows)


def test_no_rows(spark):
    assert part_codes.part_codes(frame(spark, [])).collect() == []
    assert part_codes.part_codes(frame(spark, [(1, None, 1)])).collect() == []


def test_huge_components_are_held_to_the_bound(spark):
    rows = [(1, [3e38, -3e38, 0.0, 0.0], 1), (2, [0.0] * 4, 1)]
    assert [r.error for r in part_codes.part_codes(frame(spark, rows)).collect()] == [0, 0]


@pytest.mark.parametrize("together", [1, 7, 256])
def test_trie_equals_all_distances(together, monkeypatch):
    monkeypatch.setattr(part_codes, "TOGETHER", together)
    rng = np.random.default_rng(together)
    parts = np.unique(rng.integers(-3, 3, (3000, 6)) * np.array([1, 1, 1, 900, 1, 5]), axis=0)
    book = rng.integers(-20, 20, (37, 6))
    gaps = ((parts[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    nearest, least = part_codes.assign(parts, book)
    assert (nearest == gaps.argmin(axis=1)).all() and (least == gaps.min(axis=1)).all()


def test_against_sql(spark):
    df = part_codes.part_codes(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    cursor = connect(SMALL).execute(part_codes.oracle())
    assert rows_of([c[0] for c in cursor.description], cursor.fetchall()) == rows_of(df.columns, df.collect())
