"""What keeps jobs within memory and disk as their tables grow; every test builds its own rows."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sherdline.functions import footprints, shapes
from sherdline.operators import blocks
from sherdline.operators import changes as ch
from sherdline.operators import contours as ct
from sherdline.operators import matching as mm
from sherdline.plans import known_queries, matching_queries, views


@pytest.fixture
def folder(spark, tmp_path):
    """A part table of 100 rows."""
    parts = spark.range(100).selectExpr(
        "id AS p_partkey", "'part ' || id AS p_name", "'Brand#' || (id % 25 + 10) AS p_brand", "900.0D + id AS p_retailprice"
    )
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_outlines_are_spread_by_their_number(spark, folder, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 4)
    assert views.Source(spark, folder)("contours_v").rdd.getNumPartitions() == 25


def test_rings_are_those_of_the_formula(spark):
    ids = spark.range(40).selectExpr("id * 180001 AS id").union(spark.sql("SELECT CAST(NULL AS BIGINT)")).union(spark.sql("SELECT -77L"))
    ring = lambda axis: F.expr(f"transform(sequence(0, CAST(360 + id % 64 AS INT) - 1), i -> {views._ring(axis, 'i')})")
    rows = ids.select(views._rings("id").alias("c"), ring("x").alias("xs"), ring("y").alias("ys"))
    assert rows.filter("c.xs <=> xs AND c.ys <=> ys").count() == 42


@pytest.mark.parametrize("name", ["match_score", "score_details", "placement"])
def test_rows_with_arrays_are_not_broadcast(spark, folder, name):
    assert "BroadcastHashJoin" not in plan_of(getattr(matching_queries, name)(views.Source(spark, folder)))


def test_only_block_rows_are_broadcast(spark, folder):
    plan = plan_of(mm.find_matches(views.Source(spark, folder)("edges_v"), 3))
    assert plan.count("LeftOuter") >= 6  # the rows with arrays stand on the left: twice three joins


def test_small_blocks_do_not_multiply_the_rows(spark):
    met = lambda q, c: pd.DataFrame({"q": [len(q)], "c": [len(c)]})
    rows = spark.range(1600).selectExpr("id", "1 AS bucket")
    pairs = blocks.meet_blocks(rows, ["bucket"], "id", met, "q long, c long", rows=4).toPandas()
    assert (pairs.q * pairs.c).sum() == 1600**2  # everything meets
    assert pairs.c.sum() <= 1600 * 2 * blocks.FEW_BLOCKS


def test_best_of_equal_vectors_goes_to_the_smaller_item(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(60)]
    found = mm.embedding_candidates(spark.createDataFrame(rows, "item long, vector array<double>"), 3, rows=4).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["item"], []).append(r["other"])
    for item, others in got.items():
        like = [i for i in range(60) if i != item and bool(i % 3) == bool(item % 3)]
        assert others == like[:3]


def test_sides_leave_python_as_a_few_numbers():
    rng = np.random.default_rng(3)
    t = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    xs, ys = 2000 + 1500 * np.cos(t) + rng.normal(0, 5, 300), 2000 + 900 * np.sin(t) + rng.normal(0, 5, 300)
    outlines = pd.Series([xs, None, np.array([1.0, 2.0])]), pd.Series([ys, None, np.array([1.0, 2.0])])
    runs = shapes.side_runs(0.04, 0.0, 0.02, 0.025, 18.0, 7, 2, 0.10).func(*outlines)
    pieces = shapes.hull_sides(3.5, 0.0, 0.06, 12.0, 78.0).func(*outlines)
    for found in (runs, pieces):
        assert found["judged"].tolist() == [True, False, False]
        assert all(len(v) == 4 for name in found if name != "judged" for v in found[name])
    assert np.isfinite(runs["confidence"][0]).all() and np.isnan(runs["confidence"][1]).all()


def test_runs_join_over_the_start():
    mask = np.array([True, True, False, True, False, True])
    assert shapes.circular_runs(mask) == [(5, 1), (3, 3)]
    assert shapes.circular_runs(np.ones(4, bool)) == [(0, 3)]
    assert shapes.circular_runs(np.zeros(4, bool)) == []


def test_footprints_of_a_batch_are_made_in_pieces(spark, monkeypatch):
    sizes = []
    whole = footprints.cell_runs
    monkeypatch.setattr(footprints, "cell_runs", lambda x, y, n, cell: (sizes.append(len(n)), whole(x, y, n, cell))[1])
    xs, ys = np.array([0.0, 4.0, 4.0, 0.0]), np.array([0.0, 0.0, 3.0, 3.0])
    made = footprints.footprint(1.0).func(pd.Series([xs] * 1100), pd.Series([ys] * 1100))
    assert len(made) == 1100 and max(sizes) == footprints.TOGETHER
    assert all(made["row"][i].tolist() == [0, 1, 2] and made["stop"][i].tolist() == [4, 4, 4] for i in (0, 511, 512, 1099))


def test_ruler_profiles_are_spread_and_the_same(spark, folder, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 4)
    source = views.Source(spark, folder)
    assert known_queries.known_ticks(source).rdd.getNumPartitions() == 25
    rows = known_queries.known_ticks(source).collect()
    assert len(rows) == 100
    for r in rows:
        places = [100 + r.id % 11 + 40 * k for k in range(5 + r.id % 6)]
        assert r.fixed == r.adaptive == ",".join(str(p) for p in places if p > 150)


def test_rows_of_named_projects_are_not_sorted(spark):
    ids = spark.createDataFrame([(2,), (2,), (3,), (None,)], "id long")
    projects = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    schema = "project_id long, fragment_id string, x double, y double, width double, height double, rotation double, scale_x double, scale_y double, is_locked boolean, z_index int, show_segmented boolean"
    state = lambda project, name: (project, name, *[1.0] * 7, False, 1, True)
    rows = spark.createDataFrame([state(1, "a"), state(2, "b"), state(2, "b"), state(None, "c"), state(4, "d"), state(4, "d")], schema)
    states = spark.createDataFrame([state(3, "e"), state(3, "e"), state(4, "f"), state(None, "g")], schema)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more ids than a broadcast may hold
    try:
        deleted = ch.delete_projects(projects, rows, ids)
        saved = ch.save_projects(rows, states, ids.withColumnRenamed("id", "project_id"))
        for df in (*deleted, saved):
            assert "ShuffledHashJoin" in plan_of(df) and "SortMergeJoin" not in plan_of(df)
        got = [sorted((r[0] or 0, *r[1:2]) for r in df.collect()) for df in (*deleted, saved)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    kept = [(0, "c"), (1, "a"), (4, "d"), (4, "d")]
    assert got == [[(0,), (1,), (1,)], kept, sorted([*kept, (3, "e"), (3, "e")])]


def tears(spark, n=300):
    rng = np.random.default_rng(5)
    make = lambda i: (i, f"F{i}A", "left", "tear", "s", i % 4, float(rng.uniform(1, 9)), *[rng.normal(size=m).tolist() for m in (80, 80, 16)], rng.uniform(size=8).tolist(), 1.0)
    names = "edge_id long, fragment_id string, position string, edge_type string, script_type string, line_count int, length_cm double"
    arrays = ", ".join(f"{c} array<double>" for c in ("shape_x", "shape_y", "fourier", "histogram"))
    return spark.createDataFrame([make(i) for i in range(n)], f"{names}, {arrays}, radius_cm double")


def test_rows_are_kept_once_and_only_block_rows_meet(spark, monkeypatch):
    kept, reads = [], blocks._read
    monkeypatch.setattr(blocks, "_store", lambda s, f, whole=blocks._store: (kept.append(whole(s, f)), kept[0])[1])
    before = set(Path(blocks.shared_folder(spark).removeprefix("file:")).glob("blocks-*"))
    found = mm.find_matches(tears(spark), 3, rows=16)
    assert "radius_cm" not in plan_of(found)  # no row with arrays moves in the search
    (folder,) = set(Path(kept[0].removeprefix("file:")).glob("blocks-*")) - before
    names = [p.name.removeprefix("__block=") for p in folder.iterdir() if p.is_dir()]
    assert len(names) > 8 and sorted(reads(str(folder), names)["edge_id"]) == list(range(300))


def test_a_store_that_only_spark_opens_gives_the_same(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, mm.find_matches(tears(spark, 120), 3, rows=16).collect()))
    opened = rows()
    monkeypatch.setattr(blocks, "_opens", lambda address: False)
    assert rows() == opened and len(opened) > 300


def test_what_python_opens():
    assert blocks._opens("file:/tmp/x") and blocks._opens("file:///tmp/x") and not blocks._opens("viewfs://store/x")


def test_small_candidate_blocks_are_read_together(monkeypatch):
    monkeypatch.setattr(blocks, "CARRIED", 10)
    met = pd.DataFrame({"__c": list("abcd"), "__rows": [4, 6, 1, 30]})
    assert list(blocks._together(met)) == [["a", "b"], ["c"], ["d"]]


def test_rows_side_by_side_travel_once(spark):
    ids = [0, 0, 3, 4, 4, 7, 8, 2046, 2047, 2050, 2051, 2055, -3, 1, None]
    rows = spark.createDataFrame([(i, None if n % 3 == 0 else float(n), [float(n)] * 2) for n, i in enumerate(ids)], "id long, x double, v array<double>")
    made = mm.side_by_side(rows, "id", 4, ["x", "v"])
    show = lambda df: sorted(str(r) for r in df.select("id", "a.x", "a.v", F.col("b.x").alias("bx"), F.col("b.v").alias("bv")).collect())
    a, b = rows.select("id", F.struct("x", "v").alias("a")), rows.select((F.col("id") - 4).alias("id"), F.struct("x", "v").alias("b"))
    assert show(made) == show(a.join(b, "id")) and made.count() == 11
    assert "Join" not in plan_of(made) and plan_of(made).count("RepartitionByExpression") + plan_of(made).count("Exchange") <= 1


def test_few_angles_and_points_are_tried_for_the_smallest_box(monkeypatch):
    rng = np.random.default_rng(9)
    tried, whole = [], shapes._small_boxes
    monkeypatch.setattr(shapes, "_small_boxes", lambda *a: (tried.append(whole(*a)), tried[-1])[1])
    for n in range(60):
        t = np.sort(rng.uniform(0, 2 * np.pi, 300))
        x, y = 900 + 700 * np.cos(t + n) + rng.normal(0, 3, 300), 900 + rng.uniform(50, 700) * np.sin(t) + rng.normal(0, 3, 300)
        x, y = shapes.dense_boundary(x, y)
        x, y = (x, y) if n % 2 else (shapes._smoothed(x, 7, 2) * 0.37, shapes._smoothed(y, 7, 2) * 0.37)  # whole pixels or not
        hull = shapes.hull_places(x, y)
        hx, hy = x[hull], y[hull]
        ax, ay, bx, by = hx[:, None], hy[:, None], np.roll(hx, -1)[:, None], np.roll(hy, -1)[:, None]
        assert ((bx - ax) * (y - ay) - (by - ay) * (x - ax)).max() < 1e-6  # no point is outside, whatever was left out
        edges = np.arctan2(np.roll(hy, -1) - hy, np.roll(hx, -1) - hx)
        angles = np.unique(np.mod(edges + np.pi / 4, np.pi / 2) - np.pi / 4)
        cos, sin = np.cos(angles)[:, None], np.sin(angles)[:, None]
        every = np.ptp(hx * cos + hy * sin, axis=1) * np.ptp(hy * cos - hx * sin, axis=1)
        assert shapes.min_area_angle(hx, hy) == angles[np.argmin(every)]
        turned = shapes.min_area_angle(hx[::-1], hy[::-1])  # another ring, all angles
        assert np.abs(angles[every <= every.min() * (1 + 1e-9)] - turned).min() < 1e-9
    assert np.mean([t.mean() for t in tried if not t.all()]) < 0.2 and sum(not t.all() for t in tried) > 50


def test_bounds_of_a_crop_are_sought_once(spark):
    from sherdline.operators.model_outputs import crop_geometry

    rows = spark.sql("SELECT array(100.5D, 400D, 250D) AS xs, array(50D, 9000D) AS ys, 50D AS r UNION ALL SELECT NULL, array(5D), NULL")
    far = lambda c: F.array_max(c) + 5
    crop = crop_geometry(F.col("xs"), F.col("ys"), far("xs"), far("ys"), F.col("r"), 100.0, 4, 8192, True)
    assert str(crop).count("array_min(") == 2 and str(crop).count("array_max(") == 4
    made = rows.select(crop.alias("c")).select("c.*")
    got = sorted(made.collect(), key=str)
    assert [tuple(r) for r in got] == [(0, 1, None, 9, 1.0, None, 9), (96, 46, 404, 9004, 8192 / 17918.0 * 2, 283, 8192)]


def test_reconstruct_moves_only_torn_outlines(spark, folder, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 10)
    contours = views.Source(spark, folder)("contours_v")
    edges = ct.extract_edges(contours)
    below = plan_of(edges).split("RoundRobin")[-1]
    assert "_rings" not in below and "_rings" in plan_of(edges)  # outlines are made after their rows are spread
    torn = mm.torn_outlines(contours, edges)
    assert sorted(r[0] for r in torn.select("id").collect()) == sorted({r[0] for r in edges.select("id").collect()})
    assert 0 < torn.count() < contours.count()


@pytest.mark.parametrize("mode", ["window", "ratio"])
def test_bounds_of_nearer_candidates_drop_no_match(monkeypatch, mode):
    rng = np.random.default_rng(11)
    made = lambda ids: pd.DataFrame({
        "edge_id": ids, "base": [f"b{i % 40}" for i in ids], "line_count": [np.nan if i % 5 == 0 else float(i % 6) for i in ids], "length_cm": rng.uniform(1, 4, len(ids)),
        "shape": [(np.ones(160) * (i % 3) + 0.01 * rng.normal(size=160)).round(3) for i in ids], "fourier": [rng.normal(size=16) * 0.1 for i in ids],
        "histogram": [rng.uniform(size=8) for i in ids], "radius_cm": rng.uniform(1, 2, len(ids)),
    })
    q, c = made(np.arange(60)), made(np.arange(1000, 1400))
    whole, looked = mm._parts, []
    monkeypatch.setattr(mm, "_parts", lambda q, c, i, j: (looked.append(len(i)), whole(q, c, i, j))[1])
    rows = lambda f: sorted(f.sort_values(["edge_a", "score", "edge_b"]).groupby("edge_a").head(3)[["edge_a", "score", "edge_b"]].itertuples(index=False, name=None))
    plain = rows(mm._block_scorer(3, mode)(q, c))
    monkeypatch.setattr(mm, "FIRST", 40)
    assert rows(mm._block_scorer(3, mode)(q, c)) == plain and len(plain) > 150
    order = {"score": True, "edge_b": True}
    found = blocks._best(mm._block_scorer(3, mode)(q, c[:200]), "edge_a", 3, order)
    bounded = q.assign(__bound=blocks.best_bound(q["edge_id"], [found], "edge_a", 3, order))
    looked.clear()
    later = mm._block_scorer(3, mode)(bounded, c[200:])
    assert sum(looked) < 60 * 200 / 4  # pairs that cannot be among the best are not scored
    assert rows(pd.concat([found, later])) == plain
