import numpy as np
import pytest
from helpers import rows_of

from sherdline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, entry string, cell string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def exact(rows, every, k=ann.NEIGHBOURS):
    """Every query against every vector that takes part."""
    out = {}
    for q, a in rows:
        if q % every == 0:
            far = sorted((float(np.sqrt(((np.float64(a) - np.float64(b)) ** 2).sum())), i) for i, b in rows if i != q)
            out[q] = far[:k]
    return out


def found(df):
    out: dict = {}
    for q, rank, i, score in rows_of(df, "query_id", "rank", "vec_id", "score"):
        out.setdefault(q, []).append((rank, score, i))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in out.items()}


def recall(a, b):
    return sum(len({i for _, i in a[q]} & {i for _, i in b.get(q, [])}) for q in a) / sum(len(v) for v in a.values())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    every = 10 if folder == "sf0.001" else 100
    truth, got = exact(rows, every), found(ann.nearest(table, every))
    assert set(truth) == set(got) and recall(truth, got) >= 0.9
    vectors = dict(rows)
    for q, answers in got.items():
        assert len(answers) == 10 and answers == sorted(answers)
        assert all(abs(s - np.sqrt(((vectors[q] - vectors[i]) ** 2).sum())) < 1e-12 for s, i in answers)


def test_what_takes_no_part(spark):
    odd = [(1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 2]), (5, [1, float("nan"), 0]), (6, [1, float("inf"), 0]), (None, [1, 2, 3]), (7, [1, 2]), (8, [1, 2, 3, 4])]
    good = [(0, [1, 0, 0]), (100, [1, 0, 0]), (11, [1, 0, 0]), (12, [0, 2, 0]), (200, [5, 5, 5]), (13, [1, 0, 0])]
    truth = exact(good, 100)
    assert found(ann.nearest(frame(spark, odd + good + good[:2]))) == truth  # repeated rows count once; fewer than ten: all
    assert ann.nearest(frame(spark, odd[:6])).collect() == ann.nearest(frame(spark, [])).collect() == []
    assert ann.nearest(frame(spark, [(0, [1, 2, 3])])).collect() == []


def test_a_repeated_id_counts_once(spark):
    got = found(ann.nearest(frame(spark, [(0, [1, 0]), (1, [3, 0]), (1, [2, 0])])))
    assert got == {0: [(1.0, 1)]}


def test_many_equal_vectors(spark):
    """A vector that most rows share: ties go to the smaller ids, equal queries give equal answers."""
    rng = np.random.default_rng(1)
    rows = [(i, [1, 2, 3, 4]) for i in range(0, 600, 2)] + [(i, rng.normal(size=4).astype(np.float32)) for i in range(1, 200, 2)]
    assert found(ann.nearest(frame(spark, rows), 50)) == exact(rows, 50)


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).astype(np.float32)) for i in range(120)]
    assert recall(exact(rows, 10), found(ann.nearest(frame(spark, rows), 10))) >= 0.9


def test_the_walk_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    index = ann.MultiIndex(rng.normal(size=(500, 6)), 7)
    index.sizes = {c: 1 for c in range(len(index.books[0]) * len(index.books[1])) if c % 3}
    a, b = (d[0] for d in index.distances(rng.normal(size=(1, 6))))
    sums = (a[:, None] + b).ravel()
    assert index.walk(a, b, float("inf")) == [int(c) for c in np.argsort(sums, kind="stable") if int(c) in index.sizes]
    assert index.walk(a, b, 5) == index.walk(a, b, float("inf"))[:5]
