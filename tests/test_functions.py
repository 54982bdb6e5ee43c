"""Scalar rules and small numeric helpers against hand-worked values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sherdline.functions import footprints, rules, shapes, text
from sherdline.operators import catalogue as cat
from sherdline.operators import contours as ct
from sherdline.operators import ruler as ru
from sherdline.operators.matching import overlap_ratio


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_reverse_side(spark):
    pairs = {
        "OR15000_555_2_A_L [B388]": "OR15000_555_2_B_L [B388]", "OR15013_381A_L [B250]": "OR15013_381B_L [B250]",
        "x_r_1": "x_v_1", "x_12v": "x_12r", "plain": None, "AB_12C": None, "a_1B_A": "b_1B_A",
    }
    got = values(spark, [(k,) for k in pairs], "id string", text.reverse_side_id(F.col("id")))
    assert got == list(pairs.values())


def test_filter_key(spark):
    pairs = {" Find Spot! ": "find_spot", "12th": "f_12th", "***": "custom", "a--b__c": "a_b_c"}
    assert values(spark, [(k,) for k in pairs], "s string", text.filter_key(F.col("s"))) == list(pairs.values())


def test_line_count_rules(spark):
    cases = [(0.0, True), (100.0, True), (-1.0, False), (101.0, False), (2.5, False), (float("nan"), False), (None, True)]
    got = values(spark, [(v,) for v, _ in cases], "v double", rules.validate_line_count(F.col("v"))["valid"])
    assert got == [ok for _, ok in cases]


def test_backslash_is_plain_in_search(spark):
    rows = [("a\\b", None, None), ("axb", None, None)]
    df = spark.createDataFrame(rows, "fragment_id string, transcription string, notes string")
    assert [r[0] for r in df.filter(cat.keyword_predicate("A\\B")).select("fragment_id").collect()] == ["a\\b"]


def test_filter_keys_are_unique(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a 2"), (4, "a"), (5, "b")], "label_no long, label string")
    taken = spark.createDataFrame([("b",), ("a_3",)], "filter_key string")
    keys = [r["filter_key"] for r in cat.assign_filter_keys(labels, taken, text.filter_key(F.col("label"))).collect()]
    assert len(set(keys)) == 5 and not {"b", "a_3"} & set(keys) and "b_2" in keys


def test_peaks():
    v = np.array([0, 2, 2, 2, 0, 5, 0, 1, 0, 3.0])
    assert shapes.find_peaks(v, 0.5, 1).tolist() == [2, 5, 7]  # plateau middle; the last point is no peak
    assert shapes.find_peaks(v, 0.5, 3).tolist() == [2, 5]  # the highest of close peaks stays
    assert shapes.find_peaks(v, 0.5, 1, prominence=1.5).tolist() == [2, 5]
    assert shapes.find_peaks(np.zeros(10), 0.0, 1).tolist() == []


def test_prominence_stops_at_higher_peak():
    v = np.array([0, 10, 6, 8, 1, 9, 0.0])
    assert shapes._prominences(v, np.array([1, 3, 5])).tolist() == [10.0, 2.0, 8.0]


def plain_peaks(v, height, distance, prominence):
    """The same tests of peaks one by one."""
    places = [i for i in shapes._plateau_peaks(v).tolist() if v[i] >= height]
    kept = []
    for i in sorted(places, key=lambda i: (v[i], i), reverse=True):
        if all(abs(i - j) >= np.ceil(distance) for j in kept):
            kept.append(i)

    def rise(i):
        left = max((j for j in range(i) if v[j] > v[i]), default=-1)
        right = min((j for j in range(i + 1, len(v)) if v[j] > v[i]), default=len(v))
        return v[i] - max(v[left + 1 : i + 1].min(), v[i:right].min())

    return sorted(i for i in kept if prominence is None or rise(i) >= prominence)


@pytest.mark.parametrize("seed", range(40))
def test_peaks_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 6, 200).astype(float) if seed % 2 else np.round(rng.normal(0, 5, 200).cumsum(), 1)
    if seed % 3 == 0:
        v = np.abs(v - v.mean()) + np.linspace(30, 0, 200)  # ends above the peaks
    for height, distance, prominence in ((v.min(), 1, 0.0), (v.mean(), 7, 2.0), (np.percentile(v, 30), 3.4, 1.0), (v.mean(), 12, None)):
        assert shapes.find_peaks(v, height, distance, prominence).tolist() == plain_peaks(v, height, distance, prominence)


def plain_cells(x, y, cell):
    """Cells of an outline, each row's crossings one by one."""
    found = set()
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    for row in range(int(np.floor(y.min() / cell)) - 1, int(np.floor(y.max() / cell)) + 2):
        level = (row + 0.5) * cell
        hit = (y <= level) != (ny <= level)
        cross = np.sort(x[hit] + (level - y[hit]) / (ny[hit] - y[hit]) * (nx[hit] - x[hit]))
        for left, right in zip(cross[::2], cross[1::2]):
            found.update((c, row) for c in range(math.ceil(left / cell - 0.5), math.floor(right / cell - 0.5) + 1))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_footprints_against_sets_of_cells(seed):
    rng = np.random.default_rng(seed)
    cell = float(rng.choice([0.1, 0.25, 1.0]))
    shapes_ = [rng.normal(0, 3, (2, int(rng.integers(0, 30)))) for _ in range(12)]  # outlines that cross themselves, and empty ones
    shapes_ = [np.round(p) if seed % 3 == 0 else p for p in shapes_]
    sides = [shapes_[:6], shapes_[6:]]
    runs = [footprints.cell_runs(*(np.concatenate([p[i] for p in side]) for i in (0, 1)), np.array([p.shape[1] for p in side]), cell) for side in sides]
    cells = [[plain_cells(*p, cell) if p.shape[1] else set() for p in side] for side in sides]
    for side in (0, 1):
        assert footprints.sizes_of(runs[side], 6).tolist() == [len(c) for c in cells[side]]
    assert footprints.shared_cells(*runs, 6).tolist() == [len(a & b) for a, b in zip(*cells)]


def test_overlap_of_odd_rows(spark):
    square = ([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0])
    rows = [(*square, *square, 0.0, 0.0, 45.0), (*square, *square, None, 0.0, 0.0), (None, None, *square, 0.0, 0.0, 0.0), (*square, [], [], 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "ax array<double>, ay array<double>, bx array<double>, by array<double>, dx double, dy double, t double")
    got = [r[0] for r in df.select(overlap_ratio(0.01)(*[F.col(c) for c in df.columns])).collect()]
    assert abs(got[0] - (math.sqrt(2) - 1)) < 0.01 and got[1:] == [None, 0.0, 0.0]  # turned about a corner


def test_gaussian_keeps_constants_and_mass():
    assert np.allclose(shapes.gaussian_smooth(np.full(30, 7.0), 1.5), 7.0)
    spike = np.zeros(41)
    spike[20] = 1.0
    assert np.isclose(shapes.gaussian_smooth(spike, 2.0).sum(), 1.0)


def test_hull_and_rectangle():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 100, 400), rng.uniform(0, 60, 400)
    t = np.radians(25.0)
    u, v = x * np.cos(t) - y * np.sin(t), x * np.sin(t) + y * np.cos(t)
    hull = shapes.hull_places(u, v)
    hx, hy = u[hull], v[hull]
    cross = (np.roll(hx, -1) - hx)[:, None] * (v - hy[:, None]) - (np.roll(hy, -1) - hy)[:, None] * (u - hx[:, None])
    assert (cross <= 1e-9).all()  # every point on one side of every hull edge
    corners = np.array([[0, 0], [100, 0], [100, 60], [0, 60.0]])
    cx, cy = corners[:, 0] * np.cos(t) - corners[:, 1] * np.sin(t), corners[:, 0] * np.sin(t) + corners[:, 1] * np.cos(t)
    assert np.isclose(np.degrees(shapes.min_area_angle(cx, cy)), 25.0)


def test_straight_pieces_match_plain_scan():
    rng = np.random.default_rng(5)
    for _ in range(5):
        x = np.cumsum(rng.uniform(0, 2, 200))
        y = np.cumsum(rng.normal(0, 2, 200))
        plain, current = [], [0]
        for i in range(1, 200):
            current.append(i)
            if len(current) >= 15 and shapes._mean_residual(x[current], y[current]) > 3.5:
                current.pop()
                if len(current) >= 15:
                    plain.append((current[0], current[-1]))
                current = [i]
        if len(current) >= 15:
            plain.append((current[0], current[-1]))
        assert shapes.straight_places(x, y, 3.5, 15) == plain


def test_tick_gaps(spark):
    cases = [([100, 200, 300, 400], 100.0), ([100], None), ([], None), ([50, 150], 100.0), ([100, 200, 300, 500], 100.0)]
    got = values(spark, [(t,) for t, _ in cases], "t array<int>", ru.pixels_per_unit(F.col("t")))
    assert got == [v for _, v in cases]


def test_ruler_with_even_ticks(spark):
    profile = [200.0 if i % 40 == 20 else 20.0 for i in range(400)]
    df = spark.createDataFrame([(1, profile, 800.0)], "image_id long, profile array<double>, image_height double")
    tokens = spark.createDataFrame([(1, 0, "x", 3.0), (1, 1, "5 MM", 12.0)], "image_id long, token_no long, text string, x_max double")
    row = ru.detect_scale(df, tokens, "1").collect()[0]
    assert (row["scale_unit"], row["pixels_per_unit"], row["scale_detection_status"]) == ("mm", 40.0, "success")


def test_resample_keeps_end_points(spark):
    df = spark.createDataFrame([([0.0, 3.0, 3.0], [0.0, 0.0, 4.0]), ([1.0, 1.0], [2.0, 2.0])], "xs array<double>, ys array<double>")
    first, flat = ct.resample(df, 8, ("a", "b")).collect()
    assert (first["a"][0], first["b"][0], first["a"][-1], first["b"][-1]) == (0.0, 0.0, 3.0, 4.0)
    assert flat["a"] is None


def test_piece_types(spark):
    cases = [((False,) * 4, "interior"), ((True, False, False, False), "edge"), ((True, False, True, False), "corner"), ((True, True, False, False), "edge"), ((None, None, True, None), "edge")]
    got = values(spark, [c for c, _ in cases], "t boolean, b boolean, l boolean, r boolean", rules.piece_type(*[F.col(c) for c in "tblr"]))
    assert got == [k for _, k in cases]


@pytest.mark.parametrize("value,expected", [("Early South Turkestan Brahmi", "Early South Turkestan Brāhmī"), ("Other", "Other"), ("", None), (None, None)])
def test_script_names(spark, value, expected):
    assert values(spark, [(value,)], "s string", text.script_display(F.col("s"))) == [expected]
