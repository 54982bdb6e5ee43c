"""Operators without SQL, against brute force on small inputs, with hot keys where skew matters."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sherdline.operators import borders as bd
from sherdline.operators import changes as ch
from sherdline.operators import layout as lay
from sherdline.operators import matching as mm
from sherdline.operators import metrics as mt
from sherdline.operators import model_outputs as mo
from sherdline.operators import ordering as od
from sherdline.operators import ranking as rk
from sherdline.sources import readers as rd
from sherdline.streaming.ingest import ingest_stream, pending


def hot(n=600, seed=1):
    """A third of the rows under one key."""
    rng = random.Random(seed)
    return pd.DataFrame({
        "k": ["hot" if i % 3 == 0 else rng.choice("abcdef") for i in range(n)], "i": range(n), "v": [rng.randint(0, 40) for _ in range(n)],
    })


def test_ranks_with_hot_key(spark):
    p = hot()
    df = spark.createDataFrame(p)
    got = od.sorted_rank(df, ["k"], [F.col("v"), F.col("i")]).toPandas().sort_values("i")
    want = p.sort_values(["v", "i"]).groupby("k").cumcount().add(1).sort_index()
    assert got["rank"].tolist() == want.tolist()
    assert got["rank_of"].tolist() == p.groupby("k")["i"].transform("size").tolist()
    shuffled = od.shuffle_rank(df, ["k"], "s", "i").toPandas()
    for _, g in shuffled.groupby("k"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))


def test_running_max_over_blocks(spark):
    p = hot()
    df = spark.createDataFrame(p)
    for inclusive in (True, False):
        got = od.running_max(df, ["k"], "i", F.col("v"), "m", inclusive, block=50).toPandas().sort_values("i")["m"]
        want = p.groupby("k")["v"].cummax() if inclusive else p.groupby("k")["v"].transform(lambda s: s.cummax().shift())
        assert np.array_equal(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_quantile_and_median(spark):
    p = hot()
    df = spark.createDataFrame(p)
    got = {r["k"]: r["q"] for r in od.at_quantile(df, ["k"], "v", "i", 0.95, "q").collect()}
    for k, g in p.groupby("k"):
        assert got[k] == sorted(g["v"])[int(np.ceil(0.95 * len(g))) - 1]
    medians = {r["k"]: r["m"] for r in od.median_of(df, ["k"], "v", "i", "m").collect()}
    assert medians == p.groupby("k")["v"].median().to_dict()


def test_ranks_of_odd_values_are_selected(spark, monkeypatch):
    """NULL, NaN, infinite, equal, subnormal and huge values, a NULL key and a key of one row: all ranks, by literal rows and by joins."""
    rng = np.random.default_rng(8)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0000000000000002]
    rows = [("h", x) for x in odd * 3] + [("h", float(x)) for x in rng.normal(size=400)] + [("h", 7.25)] * 300
    rows += [(None, float(x)) for x in rng.integers(-3, 3, 40)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    place = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    want = {}
    for k in ("h", None, "one"):
        own = sorted((v for kk, v in rows if kk == k), key=place)
        want |= {(k, i + 1): place(v) for i, v in enumerate(own) if i % 7 == 0}
    every = F.filter(F.sequence(F.lit(1), F.col("n")), lambda r: r % 7 == 1)
    for few, crowd in ((10_000, 100_000), (10_000, 1), (0, 1)):
        monkeypatch.setattr(od, "_FEW_ROWS", few)
        monkeypatch.setattr(od, "_CROWD", crowd)
        got = {(r["k"], r["rank"]): place(r["v"]) for r in od.select_ranks(df, ["k"], "v", every).collect()}
        assert got == want
    assert od.select_ranks(df.limit(0), ["k"], "v", every).collect() == []


def test_quantiles_move_no_rows(spark):
    """No checkpoint and no exchange of rows: what is shuffled are counts."""
    df = spark.range(0, 50_000, numPartitions=4).selectExpr("'k' AS k", "id", "CAST(id * 7919 % 50021 AS DOUBLE) AS v")
    found = od.at_quantile(df, ["k"], "v", "id", 0.95, "q")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "RepartitionByExpression" not in plan
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in executed and "SortMergeJoin" not in executed
    assert found.collect()[0]["q"] == sorted(i * 7919 % 50021 for i in range(50_000))[47_499]


def test_group_split_keeps_collections_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["A"] * 5 + list("BCDEFGH")), *[rng.random() < 0.4 for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, collection string, has_top_edge boolean, has_bottom_edge boolean, has_left_edge boolean, has_right_edge boolean")
    done = rk.group_split(df).toPandas()
    assert sorted(done["id"]) == list(range(300))
    assert (done.groupby("collection")["split"].nunique() == 1).all()
    with pytest.raises(ValueError):
        rk.group_split(df, 0.5, 0.1, 0.1)


def test_auto_layout_places_each_fragment_once(spark):
    rng = random.Random(4)
    rows = [(f"m{i:03}", f"f{rng.randint(0, 20)}", f"f{rng.randint(0, 20)}", float(i), 0.9, 1, float(i % 5), 1.0, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id string, fragment_a_id string, fragment_b_id string, score double, confidence double, rank int, relative_x_cm double, relative_y_cm double, rotation_deg double")
    got = {r["fragment_id"]: (r["x"], r["y"]) for r in lay.auto_layout(df).collect()}
    want = {}
    for idx, r in enumerate(rows[:50]):
        want.setdefault(r[1], (idx % 5 * 200.0, idx // 5 * 200.0))
        x, y = want[r[1]]
        want.setdefault(r[2], (x + r[6] * 25, y + r[7] * 25))
    assert got == want


def edge_rows(n, seed=0, scripts=("s", "s", "s", "t")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        shape = rng.normal(size=(2, 80))
        shape -= shape.mean(axis=1, keepdims=True)
        rows.append((
            i, f"F{i // 2}{'AB'[i % 2]}", ["left", "right", "top", "bottom"][int(rng.integers(4))], "tear" if i % 11 else "border",
            scripts[i % len(scripts)], None if i % 7 == 0 else int(rng.integers(0, 9)), float(rng.uniform(0.5, 6)),
            shape[0].tolist(), shape[1].tolist(), rng.uniform(0, 2, 16).tolist(), (rng.integers(0, 5, 8) * 1.0).tolist(), float(rng.uniform(0.5, 2)),
        ))
    return rows


EDGES = "edge_id long, fragment_id string, position string, edge_type string, script_type string, line_count int, length_cm double, shape_x array<double>, shape_y array<double>, fourier array<double>, histogram array<double>, radius_cm double"


def brute_scores(rows):
    def js(p, q):
        p, q = np.array(p) + 1e-10, np.array(q) + 1e-10
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return 0.5 * (np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m)))

    group = {"left": 0, "right": 0, "top": 1, "bottom": 1}
    best = {}
    for a in rows:
        found = []
        for b in rows:
            if "border" in (a[3], b[3]) or a[4] != b[4] or group[a[2]] != group[b[2]] or a[1].rstrip("AB") == b[1].rstrip("AB"):
                continue
            if not (a[6] * 0.7 <= b[6] <= a[6] * 1.3) or (a[5] is not None and b[5] is not None and abs(a[5] - b[5]) > 2):
                continue
            pa, pb = np.array(a[7:9]), np.array(b[7:9])[:, ::-1]
            score = (
                0.3 * np.sqrt(np.mean((pa - pb) ** 2)) + 0.15 * np.linalg.norm(np.array(a[9]) - np.array(b[9]))
                + 0.25 * abs(a[6] - b[6]) / max(a[6], b[6]) + 0.15 * np.sqrt(np.mean((pa * a[11] - pb * b[11]) ** 2)) + 0.15 * js(a[10], b[10])
            )
            found.append((round(score, 9), b[0]))
        best[a[0]] = sorted(found)[:4]
    return {k: v for k, v in best.items() if v}


@pytest.mark.parametrize("block", [16, 4096])
def test_matches_equal_brute_force(spark, block):
    rows = edge_rows(240)
    found = mm.find_matches(spark.createDataFrame(rows, EDGES), 4, rows=block).toPandas().sort_values(["edge_a", "rank"])
    got = {int(a): list(zip(g["score"].round(7), g["edge_b"])) for a, g in found.groupby("edge_a")}
    want = {a: [(round(s, 7), b) for s, b in v] for a, v in brute_scores(rows).items()}
    assert got == want


def test_copies_do_not_multiply(spark):
    """Many copies of one edge tie on every score; each query still gets exactly k rows, lowest ids first."""
    rows = edge_rows(1, scripts=("s",))
    copies = [(i, f"C{i}x", "left", "tear", "s", 3, 2.0, *rows[0][7:]) for i in range(200)]
    found = mm.find_matches(spark.createDataFrame(copies, EDGES), 3, rows=32).toPandas()
    assert (found.groupby("edge_a").size() == 3).all()
    assert sorted(found[found["edge_a"] == 0]["edge_b"]) == [1, 2, 3]


def test_windows_nest(spark):
    df = spark.createDataFrame(edge_rows(200, 5), EDGES)
    window = {r["edge_a"]: r["n"] for r in mm.candidate_edges(df, "window").collect()}
    ratio = {r["edge_a"]: r["n"] for r in mm.candidate_edges(df, "ratio").collect()}
    assert all(n <= ratio[a] for a, n in window.items())


def counted_plainly(rows, mode):
    """Every pair by itself; a NULL fragment id is a base of its own."""
    axis = {"left": 0, "right": 0, "top": 1, "bottom": 1}
    kept = [r for r in rows if r[3] == "tear" and r[4] and r[2] in axis and r[6] is not None and 0 < r[6] < 1e11]
    base = lambda r: None if r[1] is None else r[1].rstrip("AB")
    out = {}
    for a in kept:
        for b in kept:
            near = a[6] * (1 - 0.3) <= b[6] <= a[6] * (1 + 0.3) if mode == "window" else abs(a[6] - b[6]) / max(a[6], b[6]) <= 0.3
            lines = a[5] is None or b[5] is None or abs(a[5] - b[5]) <= 2
            if a[4] == b[4] and axis[a[2]] == axis[b[2]] and base(a) != base(b) and near and lines:
                n, ids, gap = out.get(a[0], (0, 0, 0.0))
                out[a[0]] = (n + 1, ids + b[0], gap + abs(a[6] - b[6]))
    return {a: (n, ids, pytest.approx(gap / n, abs=1e-9)) for a, (n, ids, gap) in out.items()}


@pytest.mark.parametrize("mode", ["window", "ratio"])
def test_candidate_counts_equal_brute_force(spark, mode):
    """A base of 80 edges, lengths that tie and lie on the ends of windows, missing counts and ids, odd lengths, a row twice."""
    rng = np.random.default_rng(3)
    lengths = [1.0, 0.7, 1.3, 0.49, 1.0 / 0.7, 10.0, 7.0, 13.0, 9.1, 6.999999999999999]
    rows = []
    for i in range(500):
        fragment = None if i % 41 == 0 else "HOT1A" if i % 6 == 0 else f"F{i % 90}{'AB'[i % 2]}"
        length = lengths[int(rng.integers(10))] if i % 3 else float(rng.uniform(0.4, 14))
        length = {77: float("nan"), 78: float("inf"), 79: 0.0, 80: None, 81: 5e11}.get(i, length)
        lines = None if i % 13 == 0 else int(rng.integers(-1, 9))
        rows.append((i, fragment, ("left", "right", "top", "bottom")[int(rng.integers(4))], "border" if i % 17 == 0 else "tear",
                     ("s", "s", "t", "", None)[int(rng.integers(5))], lines, length, [0.0], [0.0], [0.0], [0.0], 1.0))
    rows.append(rows[100])
    found = mm.candidate_edges(spark.createDataFrame(rows, EDGES), mode, pieces=7).collect()
    want = counted_plainly(rows, mode)
    assert len(found) == len(want) > 200
    assert {r["edge_a"]: (r["n"], r["id_sum"], r["mean_gap"]) for r in found} == want


def test_candidate_counts_of_chosen_and_no_edges(spark):
    df = spark.createDataFrame(edge_rows(120, 5), EDGES)
    every = {r["edge_a"]: r["n"] for r in mm.candidate_edges(df).collect()}
    asked = mm.candidate_edges(df.withColumn("asks", F.col("edge_id") % 7 == 0)).collect()
    assert {r["edge_a"]: r["n"] for r in asked} == {a: n for a, n in every.items() if a % 7 == 0}
    assert mm.candidate_edges(df.limit(0)).collect() == []


def test_candidate_counts_meet_no_pairs_of_a_bucket(spark):
    """Tasks hold an even share of the marks although all edges are copies in one bucket."""
    rows = edge_rows(1, scripts=("s",))
    copies = [(i, f"C{i}x", "left", "tear", "s", 3, 2.0, *rows[0][7:]) for i in range(6000)]
    found = mm.candidate_edges(spark.createDataFrame(copies, EDGES), pieces=8).collect()
    assert len(found) == 6000
    assert all(r["n"] == 5999 and r["id_sum"] == 5999 * 6000 // 2 - r["edge_a"] and r["mean_gap"] == 0 for r in found)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(90, 12))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, -9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, vector array<double>")
    found = mm.embedding_candidates(df, 5, rows=20).toPandas().sort_values(["item", "rank"])
    for i, g in found.groupby("item"):
        assert g["other"].tolist() == np.argsort(-like[i], kind="stable")[:5].tolist()


def test_embedding_candidates_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 0.0])]
    found = mm.embedding_candidates(spark.createDataFrame(rows, "item long, vector array<double>"), 5).collect()
    assert sorted((r.item, r.other) for r in found) == [(1, 2), (1, 8), (2, 1), (2, 8), (8, 1), (8, 2)]


def test_score_is_zero_on_own_reversal(spark):
    a = edge_rows(1)[0]
    b = (*a[:7], a[7][::-1], a[8][::-1], *a[9:])
    df = spark.createDataFrame([(a, b)], f"a struct<{EDGES.replace(' ', ':').replace(',:', ',')}>, b struct<{EDGES.replace(' ', ':').replace(',:', ',')}>")
    assert abs(df.select(mm.match_score("a", "b")["score"]).collect()[0][0]) < 1e-9


def test_placement_recovers_motion():
    rng = np.random.default_rng(6)
    for _ in range(20):
        walk = np.cumsum(rng.normal(size=60) + 1j * rng.normal(size=60))
        angle, shift = rng.uniform(-3, 3), complex(*rng.normal(size=2) * 5)
        moved = (walk - shift) * np.exp(-1j * angle)  # b in its own frame
        dx, dy, turn, error = mm.place_polylines(walk[None], moved[None])[0]
        assert np.allclose([dx, dy], [shift.real, shift.imag], atol=1e-6) and error < 1e-6
        assert abs((np.radians(turn) - angle + np.pi) % (2 * np.pi) - np.pi) < 1e-6


def test_fit_equals_svd():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.normal(size=(30, 2)), rng.normal(size=(30, 2))
        s, d = a - a.mean(0), b - b.mean(0)
        u, _, vt = np.linalg.svd(d.T @ s)
        r = vt.T @ u.T
        if np.linalg.det(r) < 0:
            vt[-1] *= -1
            r = vt.T @ u.T
        scale = np.sqrt((s**2).sum() / (d**2).sum())
        shift = a.mean(0) - scale * r @ b.mean(0)
        got = mm.fit_similarities(a[None, :, 0] + 1j * a[None, :, 1], b[None, :, 0] + 1j * b[None, :, 1])[0]
        assert np.allclose(got[:2], shift) and np.isclose(got[2], np.degrees(np.arctan2(r[1, 0], r[0, 0])))


def test_overlap_of_squares(spark):
    square = ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])
    rows = [(*square, *square, dx, 0.0, 0.0) for dx in (0.0, 2.0, 10.0)]
    df = spark.createDataFrame(rows, "ax array<double>, ay array<double>, bx array<double>, by array<double>, dx double, dy double, t double")
    got = [r[0] for r in df.select(mm.overlap_ratio(0.5)(*[F.col(c) for c in df.columns])).collect()]
    assert got == [1.0, 0.5, 0.0]


def outline(points):
    return [float(p[0]) for p in points], [float(p[1]) for p in points]


def rotated(cx, cy, w, h, degrees):
    t = np.radians(degrees)
    corners = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    return [(cx + x * np.cos(t) - y * np.sin(t), cy + x * np.sin(t) + y * np.cos(t)) for x, y in corners]


def test_oriented_borders(spark):
    shapes = [
        (1, *outline([(10, 10), (200, 10), (200, 150), (10, 150)])),
        (2, *outline(rotated(150, 150, 140, 80, 25))),
        (3, *outline([(40, 40), (220, 40), (220, 90), (170, 90), (170, 150), (220, 150), (220, 220), (40, 220)])),
    ]
    df = spark.createDataFrame(shapes, "id long, xs array<double>, ys array<double>").withColumn("pixels_per_unit", F.lit(50.0))
    for method in ("oriented_runs", "oriented_runs_scaled"):
        flags = {r["id"]: r for r in bd.edges_by_method(df, method).collect()}
        assert all(flags[i][f"has_{s}"] for i in (1, 2) for s in bd.SIDE_EDGES)
        assert flags[1]["piece_type"] == "corner" and not flags[3]["has_right_edge"]
    hull = {r["id"]: r for r in bd.edges_by_method(df, "hull_segments").collect()}
    assert hull[1]["piece_type"] == "corner"
    with pytest.raises(ValueError):
        bd.edges_by_method(df, "other")


def test_fragments_that_cannot_be_judged_stay(spark):
    good = [(10.0, 10.0), (200.0, 10.0), (200.0, 150.0), (10.0, 150.0)]
    rows = [(1, *outline(good)), (2, None, None), (3, [1.0, 2.0], [1.0, 2.0]), (4, [5.0, 6.0, 5.0], [5.0, 5.0, 6.0]), (5, [], [])]
    df = spark.createDataFrame(rows, "id long, xs array<double>, ys array<double>").withColumn("pixels_per_unit", F.lit(50.0))
    flags = ", ".join(f"has_{s} boolean" for s in bd.SIDE_EDGES)
    classified = spark.createDataFrame([(i, *[None] * 4, "no model") for i in range(1, 7)] + [(7, True, False, False, False, None)], f"id long, {flags}, error string")
    for method in bd.METHODS:
        sides = bd.METHODS[method](df)
        assert sides.groupBy("id").count().filter("count = 4").count() == len(rows)
        out = {r["id"]: r for r in bd.edges_with_fallback(df, classified, method).collect()}
        assert sorted(out) == [1, 2, 3, 4, 5, 6, 7] and out[7]["method"] == "classifier"
        assert out[1]["method"] == method and out[1]["error"] is None and out[1]["fallback_error"] == "no model"
        for i in (2, 3, 5, 6):
            assert out[i]["method"] is None and out[i]["error"] and out[i]["piece_type"] is None
        assert (out[4]["method"] is None) == (out[4]["error"] is not None)
    alone = {r["id"]: r for r in bd.edges_with_fallback(df, classified, None).collect()}
    assert len(alone) == 7 and alone[1]["error"] == "no model"


def test_repeated_edits_need_an_order(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "fragment_id string, line_count int")
    edits = spark.createDataFrame([("a", 5), ("a", 6)], "fragment_id string, line_count int")
    with pytest.raises(Exception, match="several edits"):
        ch.update_metadata(table, edits).table.collect()


def test_nothing_is_written_outside_the_shared_folder(spark):
    from sherdline.session import cut, shared_folder

    cut(spark.range(3).toDF("x")).count()
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(shared_folder(spark).removeprefix("file:"))


def test_blocks_copy_an_edge_no_more_than_its_window(spark):
    """With many blocks only those whose length ranges come within reach meet."""
    from sherdline.operators.blocks import meet_blocks

    rng = np.random.default_rng(4)
    place = rng.uniform(0, 6, 4000)
    df = spark.createDataFrame([(i, "k", float(p)) for i, p in enumerate(place)], "item long, bucket string, place double")
    reach = (-0.35, 0.26)

    def count(queries, candidates):
        gap = candidates["place"].to_numpy()[None, :] - queries["place"].to_numpy()[:, None]
        near = ((gap >= reach[0]) & (gap <= reach[1])).sum(axis=1)
        return pd.DataFrame({"item": queries["item"], "near": near, "met": len(candidates)})

    got = meet_blocks(df, ["bucket"], "item", count, "item long, near long, met long", "place", reach, rows=100).groupBy("item").sum().toPandas()
    got = got.sort_values("item")
    expected = [int(((place - p >= reach[0]) & (place - p <= reach[1])).sum()) for p in place]
    assert got["sum(near)"].tolist() == expected
    assert got["sum(met)"].mean() < 2.2 * np.mean(expected)  # three whole bins would be 2.6 times and the rest of the window


def test_threshold_tuning(spark):
    rows = [(0, 0.9, 0.45, 0.3, 0.55), (1, 0.1, 0.7, 0.55, 0.2), (2, 0.8, 0.2, 0.9, 0.6)]
    truth = [(True, True, False, True), (False, True, True, False), (True, False, True, True)]
    df = spark.createDataFrame([(*r, *t) for r, t in zip(rows, truth)], "id long, p_top double, p_bottom double, p_left double, p_right double, t_top boolean, t_bottom boolean, t_left boolean, t_right boolean")
    tuned = {r["side"]: r["threshold"] for r in mt.tune_thresholds(df, [0.4, 0.5, 0.6]).collect()}
    assert mt.multilabel_summary(df, tuned).collect()[0]["exact_match"] == 1.0
    assert {r["threshold"] for r in mt.tune_thresholds(df.limit(0)).collect()} == {0.5}


def test_weighted_sample_balances_classes(spark):
    p = hot(900)
    got = rk.weighted_sample(spark.createDataFrame(p), "k", "i", 3500).toPandas()
    assert len(got) == 3500
    shares = got["k"].value_counts(normalize=True)
    assert abs(shares - 1 / 7).max() < 0.03


def test_predictors(spark):
    @mo.register
    class LengthPredictor(mo.Predictor):
        def predict(self, row):
            if row["s"] == "bad":
                raise ValueError("bad row")
            return str(len(row["s"]))

    df = spark.createDataFrame([(1, "abc"), (2, "bad")], "id long, s string")
    got = {r["id"]: (r["prediction"], r["error"]) for r in mo.score_batches(df, "id", mo.predictor("length")).collect()}
    assert got == {1: ("3", None), 2: (None, "bad row")}
    with pytest.raises(Exception, match="bad row"):
        mo.score_batches(df, "id", mo.predictor("length"), continue_on_error=False).collect()
    with pytest.raises(KeyError):
        mo.predictor("nothing")


def test_classifier_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), (rng.normal(size=6) + 3 * np.eye(6)[c]).tolist()) for c in rng.integers(0, 3, 200)]
    df = spark.createDataFrame(rows, "label int, features array<double>")
    model = mo.train_classifier(df, "features", "label", range(3))
    guessed = mo.predict_classes(model, df, "features").select(F.col("label").alias("truth"), F.col("prediction").cast("int").alias("predicted"))
    assert mt.multiclass_metrics(guessed).collect()[0]["accuracy"] > 0.9


def test_files(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("0 1 1 1 1\n\n0 2 2 2 2\n")
    (tmp_path / "counts.csv").write_text("File Name,Line Count\na.jpg,3\nb.jpg,x\n")
    (tmp_path / "run.log").write_text("INFO ok\n ERROR one\nCRITICAL two\n")
    (tmp_path / "store.json").write_text(json.dumps({"annotations": {"C\\a.jpg": {"has_top_edge": True, "has_left_edge": "yes", "reviewed": 1}}}))
    assert [(r["image"], r["boxes"]) for r in rd.load_label_txt(spark, str(tmp_path / "labels")).collect()] == [("a", 2)]
    assert [r["label"] for r in rd.load_label_csv(spark, str(tmp_path / "counts.csv"), "Line Count").collect()] == [3, None]
    log = rd.scan_log_errors(rd.read_log(spark, str(tmp_path / "run.log"))).collect()[0]
    assert (log["error_lines"], log["sample"]) == (2, ["ERROR one", "CRITICAL two"])
    row = rd.load_annotations(spark, str(tmp_path / "store.json")).collect()[0]
    assert (row["path"], row["has_top_edge"], row["has_left_edge"], row["reviewed"]) == ("C/a.jpg", True, None, True)


class Stream:
    """A source folder, its table, and runs of the stream over what is there."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.table, self.check = spark, str(folder / "in"), folder / "table", folder / "check"

    def bring(self, rows, check=None, scorers=None):
        """Adds (id, path, script, circle) rows as one file and runs the stream to its end."""
        schema = "id string, path string, script string, circle boolean"
        if rows is not None:
            self.spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], schema).coalesce(1).write.mode("append").parquet(self.source)
        to_rows = lambda b: b.selectExpr("id AS fragment_id", "path AS image_path", "script AS script_type", "circle AS has_circle")
        ingest_stream(self.spark, self.source, schema, to_rows, str(self.table), str(check or self.check), scorers=scorers).awaitTermination()

    def rows(self):
        return sorted((r["fragment_id"], r["image_path"], r["batch_id"]) for r in pending(self.spark, str(self.table)).collect())


def test_stream_takes_each_fragment_once(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    assert stream.rows() == []
    stream.bring([("a", "2.jpg"), ("b", "1.jpg"), ("a", "1.jpg"), (None, "n.jpg"), ("n", None)])
    stream.bring([("b", "0.jpg"), ("c", "9.jpg")])
    assert stream.rows() == [("a", "1.jpg", 0), ("b", "1.jpg", 0), ("c", "9.jpg", 1)]


def test_stream_reads_no_earlier_partition(spark, tmp_path):
    """The first batch's files hold no Parquet while the second runs."""
    stream = Stream(spark, tmp_path)
    stream.bring([("a", "1.jpg"), ("b", "1.jpg")])
    written = {f: f.read_bytes() for f in stream.table.rglob("*") if f.is_file() and "batch_id=0" in str(f)}
    assert any(f.suffix == ".parquet" for f in written)
    for f in written:
        f.write_bytes(b"none")
    stream.bring([("a", "0.jpg"), ("c", "1.jpg")])
    for f, data in written.items():
        f.write_bytes(data)
    assert stream.rows() == [("a", "1.jpg", 0), ("b", "1.jpg", 0), ("c", "1.jpg", 1)]


def test_stream_batch_that_runs_again_doubles_nothing(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.bring([("a", "1.jpg")])
    stream.bring([("a", "0.jpg"), ("b", "1.jpg")])
    want = stream.rows()
    for name in ("1", ".1.crc"):  # as if the driver was lost after the write of batch 1
        (stream.check / "commits" / name).unlink(missing_ok=True)
    stream.bring(None)
    assert stream.rows() == want == [("a", "1.jpg", 0), ("b", "1.jpg", 1)]


def test_stream_with_a_new_checkpoint_keeps_the_table(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.bring([("a", "1.jpg"), ("b", "1.jpg")])
    stream.bring([("c", "1.jpg")], check=tmp_path / "other")  # reads both files anew
    stream.bring([("c", "0.jpg"), ("d", "1.jpg")], check=tmp_path / "other")
    assert [r[0] for r in stream.rows()] == ["a", "b", "c", "d"]
    assert [r[1] for r in stream.rows()] == ["1.jpg"] * 4


def test_stream_names_the_scorers_a_row_needs(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.bring([("a", "1.jpg"), ("b", "1.jpg", "s", True), ("c", "1.jpg", None, False)], scorers={"script": "v1", "circle": "1", "edges": "2"})
    got = {r["fragment_id"]: r["to_score"] for r in pending(spark, str(stream.table)).collect()}
    assert got == {"a": ["circle", "edges", "script"], "b": ["edges", "script"], "c": ["edges", "script"]}
