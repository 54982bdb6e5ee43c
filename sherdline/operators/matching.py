"""Edge matching: candidates, scores, placement, and the whole reconstruction job."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import polyline as pl
from ..functions.footprints import footprint, overlap_with
from ..functions.text import base_id
from ..session import cut
from . import contours as ct
from .blocks import best_bound, keep_best, meet_blocks
from .ordering import running_sums
from .ranking import rank_matches, rerank

# Fixed values of the score and the candidate test.
WEIGHTS = {"shape": 0.30, "fourier": 0.15, "length": 0.25, "cm_shape": 0.15, "histogram": 0.15}
LINE_TOLERANCE = 2
LENGTH_TOLERANCE = 0.30
POINTS = 80
FEW = 32  # edges of one base and bucket that may meet pair by pair
EPS = 1e-10

#: Log lengths of a candidate minus its query's, for the two candidate tests (a hair wider, for rounding).
REACH = {
    "window": (math.log(1.0 - LENGTH_TOLERANCE) - 1e-9, math.log(1.0 + LENGTH_TOLERANCE) + 1e-9),
    "ratio": (math.log(1.0 - LENGTH_TOLERANCE) - 1e-9, -math.log(1.0 - LENGTH_TOLERANCE) + 1e-9),
}
CELLS = 1 << 21  # pairs of two blocks that are scored together
FIRST = 1024  # candidates that a query meets before its best matches bound the others
PAIRS = 1 << 14  # pairs that are scored term by term together
SCORE_PLACES = 9  # scores are rounded so that equal scores tie in every plan

PAIR_SCHEMA = (
    "edge_a {0}, edge_b {0}, score double, shape double, fourier double, length double, cm_shape double, histogram double"
)


def wide(df: DataFrame) -> DataFrame:
    """Rows with whole arrays in a join by their id: sorted and merged.  Spark's size estimate takes an array for one
    element, so it would send them through the driver as a broadcast."""
    return df.hint("merge")


SPAN = 2048  # keys that lie in one group of :func:`side_by_side`
SIDE_ROWS = 32768  # rows of one of its tasks


def side_by_side(rows: DataFrame, key: str, shift: int, names: Sequence[str]) -> DataFrame:
    """``key, a, b``: every row with each row whose whole-number ``key`` is ``shift`` more, as structs of the columns ``names``.

    The inner join of the rows with themselves, but a row travels once: keys are grouped by ranges, and only a row whose
    partner's range is another one goes to both.  A window then finds the partners.  Columns that nobody asks for do
    not travel.
    """
    at = F.col(key).cast("long")
    start = lambda k: k - F.pmod(k, F.lit(SPAN))
    known = rows.filter(F.col(key).isNotNull())
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-known.count() // SIDE_ROWS))
    groups = F.array_distinct(F.array(start(at), start(at - shift)))
    dealt = known.select(at.alias("__at"), F.explode(groups).alias("__group"), *names).repartition(tasks, "__group")
    ahead = Window.partitionBy("__group").orderBy("__at").rangeBetween(shift, shift)
    partners = {f"__b{i}": F.collect_list(F.struct(n)).over(ahead) for i, n in enumerate(names)}  # structs: NULL values count
    met = dealt.withColumns({**partners, "__n": F.count(F.lit(1)).over(ahead)}).filter((F.col("__group") == start(F.col("__at"))) & (F.col("__n") > 0))
    each = met.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1)))
    b = F.struct(*[F.get(f"__b{i}", F.col("__i"))[n].alias(n) for i, n in enumerate(names)])
    return each.select(F.col("__at").alias(key), F.struct(*names).alias("a"), b.alias("b"))


def matchable(edges: DataFrame) -> DataFrame:
    """Torn edges with a script and a side, with the columns the block join needs.

    ``edges`` has ``edge_id, fragment_id, position, edge_type, script_type, line_count, length_cm,
    shape_x, shape_y`` (80 centred points), ``fourier, histogram, radius_cm``.
    """
    sides = F.col("position").isin("left", "right", "top", "bottom")
    kept = edges.filter((F.col("edge_type") == "tear") & (F.length("script_type") > 0) & sides & (F.col("length_cm") > 0))
    return kept.select(
        "edge_id", "script_type",
        F.when(F.col("position").isin("left", "right"), "across").otherwise("down").alias("axis"),
        F.log("length_cm").alias("log_length"), (F.col("asks") if "asks" in edges.columns else F.lit(True)).alias("asks"),
        base_id(F.col("fragment_id")).alias("base"),
        F.col("line_count").cast("double").alias("line_count"), F.col("length_cm").cast("double").alias("length_cm"),
        F.concat("shape_x", "shape_y").alias("shape"), "fourier", "histogram", F.col("radius_cm").cast("double").alias("radius_cm"),
    )


def _compatible(q: pd.DataFrame, c: pd.DataFrame, mode: str) -> np.ndarray:
    """Which candidate (column) may match which query (row)."""
    names, codes = np.unique(np.concatenate((q["base"].to_numpy(str), c["base"].to_numpy(str))), return_inverse=True)
    other = codes[: len(q)][:, None] != codes[len(q) :][None, :]
    lines = np.abs(q["line_count"].to_numpy(float)[:, None] - c["line_count"].to_numpy(float)[None, :])
    a, b = q["length_cm"].to_numpy()[:, None], c["length_cm"].to_numpy()[None, :]
    if mode == "window":
        near = (b >= a * (1.0 - LENGTH_TOLERANCE)) & (b <= a * (1.0 + LENGTH_TOLERANCE))
    else:
        near = np.abs(a - b) / np.maximum(a, b) <= LENGTH_TOLERANCE
    return other & near & ~(lines > LINE_TOLERANCE)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows, from products."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _reversed(shape: np.ndarray) -> np.ndarray:
    n = shape.shape[1] // 2
    return np.concatenate((shape[:, :n][:, ::-1], shape[:, n:][:, ::-1]), axis=1)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of paired rows, natural logarithm."""
    p, q = p + EPS, q + EPS
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
    m = 0.5 * (p + q)
    return 0.5 * ((p * np.log(p / m)).sum(axis=1) + (q * np.log(q / m)).sum(axis=1))


def _parts(q: dict, c: dict, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """The five parts of the score for the pairs (i, j), term by term."""
    a, b, ra, rb = q["shape"][i], c["flipped"][j], q["radius"][i], c["radius"][j]
    n = math.sqrt(a.shape[1])
    cm = np.sqrt(((a * ra[:, None] - b * rb[:, None]) ** 2).sum(axis=1)) / n
    return {
        "shape": np.sqrt(((a - b) ** 2).sum(axis=1)) / n,
        "fourier": np.sqrt(((q["fourier"][i] - c["fourier"][j]) ** 2).sum(axis=1)),
        "length": np.abs(q["length"][i] - c["length"][j]) / np.maximum(q["length"][i], c["length"][j]),
        "cm_shape": np.where(np.isnan(cm), 1.0, cm),
        "histogram": _divergence(q["histogram"][i], c["histogram"][j]),
    }


def _features(d: pd.DataFrame) -> dict[str, np.ndarray]:
    shape = _matrix(d["shape"])
    return {
        "shape": shape, "flipped": _reversed(shape), "fourier": _matrix(d["fourier"]), "histogram": _matrix(d["histogram"]),
        "length": d["length_cm"].to_numpy(), "radius": d["radius_cm"].to_numpy(float),
    }


def _tiles(queries: pd.DataFrame, candidates: pd.DataFrame):
    """The queries in pieces that make at most ``CELLS`` pairs, one at least."""
    step = max(1, CELLS // max(1, len(candidates)))
    return (queries.iloc[at : at + step] for at in range(0, len(queries) if len(candidates) else 0, step))


def _pairs_compatible(q: pd.DataFrame, c: pd.DataFrame, i: np.ndarray, j: np.ndarray, mode: str) -> np.ndarray:
    """As :func:`_compatible` for the pairs (i, j)."""
    names, codes = np.unique(np.concatenate((q["base"].to_numpy(str), c["base"].to_numpy(str))), return_inverse=True)
    lines = np.abs(q["line_count"].to_numpy(float)[i] - c["line_count"].to_numpy(float)[j])
    a, b = q["length_cm"].to_numpy()[i], c["length_cm"].to_numpy()[j]
    if mode == "window":
        near = (b >= a * (1.0 - LENGTH_TOLERANCE)) & (b <= a * (1.0 + LENGTH_TOLERANCE))
    else:
        near = np.abs(a - b) / np.maximum(a, b) <= LENGTH_TOLERANCE
    return (codes[: len(q)][i] != codes[len(q) :][j]) & near & ~(lines > LINE_TOLERANCE)


def _block_scorer(k: int, mode: str):
    """Best k candidates per query inside one pair of blocks.

    All parts but the histogram come from matrix products.  They bound the score from below, so the
    histogram part is worked out only for pairs that can still be among the best k.  Where queries have k
    matches already (``__bound``), only pairs that shape and length leave in reach of them are looked at.
    """

    def score(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return empty
        queries, candidates = queries.sort_values("length_cm"), candidates.sort_values("length_cm")
        features = _features(candidates)
        some = lambda *ends: (candidates.iloc[slice(*ends)], {n: v[slice(*ends)] for n, v in features.items()})
        tiles = []
        for q in _tiles(queries, candidates):
            if len(candidates) > 2 * FIRST and ("__bound" not in q or q["__bound"].isna().any()):
                # the candidates nearest in length first: what they leave open is a small part of the others
                low = max(0, int(np.searchsorted(features["length"], q["length_cm"].median())) - FIRST // 2)
                tiles.append(tile(q, *some(low, low + FIRST)))
                q = q.assign(__bound=best_bound(q["edge_id"], tiles[-1:], "edge_a", k, {"score": True}))
                tiles += [tile(q, *some(0, low)), tile(q, *some(low + FIRST, None))]
            else:
                tiles.append(tile(q, candidates, features))
        return pd.concat(tiles)

    empty = pd.DataFrame({n: pd.Series(dtype=object if n.startswith("edge") else float) for n in ("edge_a", "edge_b", "score", *WEIGHTS)})

    def tile(queries: pd.DataFrame, candidates: pd.DataFrame, c: dict) -> pd.DataFrame:
        if not len(candidates):
            return empty
        q = _features(queries)
        bound = queries["__bound"].to_numpy(float) if "__bound" in queries else np.full(len(queries), np.nan)
        most = bound.max()  # NaN while a query has fewer than k
        gap = LENGTH_TOLERANCE if np.isnan(most) else min(LENGTH_TOLERANCE, (most + 1e-7) / WEIGHTS["length"])
        ends = q["length"][0] * (1.0 - gap) * (1.0 - 1e-9), q["length"][-1] / (1.0 - gap) * (1.0 + 1e-9)
        near = slice(np.searchsorted(c["length"], ends[0], "left"), np.searchsorted(c["length"], ends[1], "right"))
        candidates, c = candidates.iloc[near], {n: v[near] for n, v in c.items()}
        if not len(candidates):
            return empty
        if np.isnan(most):
            i, j = among(q, c, _compatible(queries, candidates, mode))
        else:
            i, j = bounded(q, c, bound + 1e-7)
            fits = _pairs_compatible(queries, candidates, i, j, mode)
            i, j = i[fits], j[fits]
        some = [_parts(q, c, i[at : at + PAIRS], j[at : at + PAIRS]) for at in range(0, len(i), PAIRS)]
        if not some:
            return empty
        parts = {w: np.concatenate([p[w] for p in some]) for w in WEIGHTS}
        scores = np.round(sum(WEIGHTS[w] * parts[w] for w in WEIGHTS), SCORE_PLACES)
        b = candidates["edge_id"].to_numpy()[j]
        order = np.lexsort((np.unique(b, return_inverse=True)[1], scores, i))
        starts = np.concatenate(([0], np.cumsum(np.bincount(i, minlength=len(queries)))[:-1]))
        kept = order[(np.arange(len(order)) - starts[i[order]]) < k]
        name = lambda values: pd.Series(values, dtype=values.dtype)  # noqa: E731 - ids may be text; plain objects join as they are
        return pd.DataFrame(
            {"edge_a": name(queries["edge_id"].to_numpy()[i[kept]]), "edge_b": name(b[kept]), "score": scores[kept], **{w: parts[w][kept] for w in WEIGHTS}}
        )

    def among(q: dict, c: dict, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may be among the best k of this block."""
        n = math.sqrt(q["shape"].shape[1])
        in_cm = _gap(q["shape"] * q["radius"][:, None], c["flipped"] * c["radius"][:, None]) / n
        longest = np.maximum(q["length"][:, None], c["length"][None, :])
        low = (
            WEIGHTS["shape"] * _gap(q["shape"], c["flipped"]) / n + WEIGHTS["fourier"] * _gap(q["fourier"], c["fourier"])
            + WEIGHTS["length"] * np.abs(q["length"][:, None] - c["length"][None, :]) / longest
            + WEIGHTS["cm_shape"] * np.where(np.isnan(in_cm), 1.0, in_cm)
        )
        low[~allowed] = np.inf
        if low.shape[1] > k:
            seed = np.argpartition(low, k - 1, axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(low)), k), seed.ravel()
            js = _divergence(q["histogram"][i], c["histogram"][j])
            reach = (low[i, j] + WEIGHTS["histogram"] * js).reshape(len(low), k).max(axis=1)
            possible = low <= reach[:, None] + 1e-7
        else:
            possible = np.ones_like(allowed)
        return np.nonzero(possible & allowed)

    def bounded(q: dict, c: dict, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose shapes, lengths, Fourier terms and shapes in cm leave them within each query's limit."""
        n = q["shape"].shape[1]
        qs, cs = (q["shape"] ** 2).sum(axis=1), (c["flipped"] ** 2).sum(axis=1)
        dot = q["shape"] @ c["flipped"].T
        low = dot * -2.0
        low += qs[:, None]
        low += cs[None, :]
        np.maximum(low, 0.0, out=low)
        np.sqrt(low, out=low)
        low *= WEIGHTS["shape"] / math.sqrt(n)
        gap = np.abs(q["length"][:, None] - c["length"][None, :])
        gap /= np.maximum(q["length"][:, None], c["length"][None, :])
        gap *= WEIGHTS["length"]
        low += gap
        i, j = np.nonzero(low <= limit[:, None])
        kept = []
        for at in range(0, len(i), 8 * PAIRS):
            u, v = i[at : at + 8 * PAIRS], j[at : at + 8 * PAIRS]
            ra, rb = q["radius"][u], c["radius"][v]
            in_cm = np.sqrt(np.maximum(ra * ra * qs[u] + rb * rb * cs[v] - 2.0 * ra * rb * dot[u, v], 0.0) / n)
            terms = np.sqrt(((q["fourier"][u] - c["fourier"][v]) ** 2).sum(axis=1))
            whole = low[u, v] + WEIGHTS["fourier"] * terms + WEIGHTS["cm_shape"] * np.where(np.isnan(in_cm), 1.0, in_cm)
            kept.append(whole <= limit[u])
        fits = np.concatenate(kept) if kept else np.zeros(0, bool)
        return i[fits], j[fits]

    return score


def find_matches(edges: DataFrame, k: int = 5, mode: str = "window", rows: int = 4096) -> DataFrame:
    """The best ``k`` candidates of every matchable edge, with the parts of the score.

    With a boolean column ``asks`` only edges for which it holds are queries; all are candidates.

    ``window``: the candidate's length lies in 0.7..1.3 of the query's, as the indexed search has it.
    ``ratio``: the gap is at most 0.3 of the longer edge, as the full test has it.
    """
    schema = PAIR_SCHEMA.format(edges.schema["edge_id"].dataType.simpleString())
    scored = meet_blocks(
        matchable(edges), ["script_type", "axis"], "edge_id", _block_scorer(k, mode), schema, "log_length", REACH[mode], rows, "asks",
        ("edge_a", k, {"score": True, "edge_b": True}),
    )
    return keep_best(scored, "edge_a", k, ["score", "edge_b"])


def _window_ends(mode: str) -> tuple[Column, Column]:
    """The shortest and the longest ``length_cm`` that may match a row's own, to the last bit."""
    own = F.col("length_cm")
    low, high = own * (1.0 - LENGTH_TOLERANCE), own * (1.0 + LENGTH_TOLERANCE)
    if mode == "window":
        return low, high
    # the ratio test has no closed form that rounds alike, so the doubles around its solution are put to the test
    near = lambda at: F.transform(F.sequence(F.lit(-16), F.lit(16)), lambda k: at + at * (k * 2.0**-53))
    passes = lambda b: F.abs(own - b) / F.greatest(own, b) <= LENGTH_TOLERANCE
    return F.array_min(F.filter(near(low), passes)), F.array_max(F.filter(near(own / (1.0 - LENGTH_TOLERANCE)), passes))


def candidate_edges(edges: DataFrame, mode: str = "window", pieces: int | None = None) -> DataFrame:
    """Per edge how many candidates pass the test, the sum of their ids and their mean length gap.

    Order statistics stand in for the candidate lists, which grow with the square of a bucket.  Every edge is
    a point on the length axis and, as a query, three marks: the ends of its window and its own length.  One
    sort gives running counts and sums at the marks; what lies between two marks is their difference.  Line
    counts that may differ by two are met by laying each point on five axes.  Candidates of the query's own
    base are taken off: pair by pair in bases of at most ``FEW`` edges, in larger ones by axes of one base.  So
    the work is that of a sort of 12 to 24 small rows per edge, whatever the sizes of buckets and bases.

    ``edges`` as in :func:`matchable`, ``edge_id`` being a whole number; ``asks`` as in :func:`find_matches`.
    Line counts are whole numbers, NULL meets every count.  Edges whose length is not finite, or 1e11 cm and
    more, match nothing.  A NULL ``fragment_id`` is one base of its own.  Equal rows count as often as they
    occur, and an ``edge_id`` that occurs twice gives one row over both.  Edges without candidates have no row.
    """
    slim = matchable(edges).filter("length_cm < 1e11").select(
        "edge_id", "script_type", "axis", "length_cm", "asks", F.col("line_count").cast("long").alias("lines"),
        F.coalesce(F.concat(F.lit("1"), "base"), F.lit("0")).alias("base"),
    )
    slim = cut(slim.withColumns(dict(zip(("low", "high"), _window_ends(mode)))))  # the edges' own work is done once
    bucket = ["script_type", "axis"]
    crowds = slim.groupBy(*bucket, "base").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > FEW).drop("size")
    known, nothing = F.col("lines").isNotNull(), F.lit(0).cast("long")
    on = lambda kind, lines: F.struct(F.lit(kind).alias("kind"), lines.alias("lines"))
    unknown, every = on("unknown", nothing), on("every", nothing)
    around = [on("near", F.col("lines") + F.lit(d).cast("long")) for d in range(-LINE_TOLERANCE, LINE_TOLERANCE + 1)]
    stands_on = F.when(known, F.array(*around, every)).otherwise(F.array(unknown, every))
    asks_on = F.when(known, F.array(on("near", F.col("lines")), unknown)).otherwise(F.array(every))

    def mark(at: str, step: int, counts: int, gaps: int) -> Column:
        """``step`` orders equal lengths: marks that leave them out, points, marks that take them in."""
        return F.struct(F.col(at).alias("at"), F.lit(step).alias("step"), F.lit(counts).alias("counts"), F.lit(gaps).alias("gaps"))

    # gaps: a * (2 N(a) - N(low) - N(high)) - (2 S(a) - S(low) - S(high)), N and S running counts and lengths
    marks = F.array(mark("low", 0, -1, -1), mark("length_cm", 2, 0, 2), mark("high", 2, 1, -1))

    def laid(rows: DataFrame, of: Column, sign: int) -> DataFrame:
        """Points and marks of the rows; the marks' shares count ``sign`` times.  Sums are exact, since a
        window's share is the difference of two much larger ones."""
        own = rows.withColumn("of", of)
        points = own.withColumn("on", F.explode(stands_on)).withColumn("m", mark("length_cm", 1, 0, 0))
        asked = own.filter("asks").withColumn("on", F.explode(asks_on)).withColumn("m", F.explode(marks))
        columns = [
            *bucket, "of", F.col("on.kind").alias("kind"), F.col("on.lines").alias("lines"), F.col("m.at").alias("at"), F.col("m.step").alias("step"),
            "edge_id", "length_cm", (F.col("m.counts") * sign).alias("counts"), (F.col("m.gaps") * sign).alias("gaps"),
        ]
        value = lambda n, ids, lengths: [n.cast("long").alias("n"), ids.cast("decimal(20,0)").alias("ids"), lengths.cast("decimal(24,12)").alias("lengths")]
        return points.select(*columns, *value(F.lit(1), F.col("edge_id"), F.col("length_cm"))).unionByName(
            asked.select(*columns, *value(F.lit(0), F.lit(0), F.lit(0)))
        )

    events = laid(slim, F.lit(""), 1).unionByName(laid(slim.join(crowds, [*bucket, "base"], "left_semi"), F.col("base"), -1))
    summed = running_sums(events, [*bucket, "of", "kind", "lines"], ["at", "step", "edge_id"], ["n", "ids", "lengths"], pieces)
    met = summed.filter("step <> 1").groupBy(F.col("edge_id").alias("edge_a"), "length_cm").agg(
        F.sum(F.col("counts") * F.col("n")).alias("n"), F.sum(_signed("counts", "ids")).alias("id_sum"),
        F.sum(F.col("gaps") * F.col("n")).alias("gap_count"), F.sum(_signed("gaps", "lengths")).alias("gap_length"),
    )
    gap = F.col("length_cm") * F.col("gap_count") - F.col("gap_length").cast("double")
    few = slim.join(crowds, [*bucket, "base"], "left_anti").select(*bucket, "base", "edge_id", "length_cm", "lines", "low", "high", "asks")
    others = few.select(*bucket, "base", F.col("edge_id").alias("b_id"), F.col("length_cm").alias("b_length"), F.col("lines").alias("b_lines"))
    akin = few.filter("asks").join(others, [*bucket, "base"]).filter(
        F.col("b_length").between(F.col("low"), F.col("high"))
        & ~F.coalesce(F.abs(F.col("lines") - F.col("b_lines")) > LINE_TOLERANCE, F.lit(False))
    )
    own = akin.groupBy(F.col("edge_id").alias("edge_a")).agg(
        (-F.count(F.lit(1))).alias("n"), (-F.sum(F.col("b_id").cast("decimal(20,0)"))).alias("id_sum"),
        (-F.sum(F.abs(F.col("length_cm") - F.col("b_length")))).alias("gap"),
    )
    per_edge = met.select("edge_a", "n", "id_sum", gap.alias("gap")).unionByName(own).groupBy("edge_a").agg(
        F.sum("n").alias("n"), F.sum("id_sum").cast("long").alias("id_sum"), F.sum("gap").alias("gap_sum")
    )
    return per_edge.filter("n > 0").select("edge_a", "n", "id_sum", (F.greatest("gap_sum", F.lit(0.0)) / F.col("n")).alias("mean_gap"))


def _signed(factor: str, value: str) -> Column:
    """A decimal times -2..2 without the digits that a product would add."""
    by, v = F.col(factor), F.col(value)
    return F.when(by == 1, v).when(by == -1, -v).when(by == 2, v + v).when(by == -2, -(v + v)).otherwise(F.lit(0))


def match_score(a: str, b: str) -> dict[str, Column]:
    """Score columns for pairs already side by side, ``a`` and ``b`` being struct columns of edges."""
    fa, fb = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    back = lambda n: F.reverse(fb(n))
    squares = lambda u, v: pl.total(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)))
    count = F.size(fa("shape_x")) * 2
    in_cm = lambda f, values: F.transform(values, lambda v: v * f("radius_cm"))
    shape = F.sqrt((squares(fa("shape_x"), back("shape_x")) + squares(fa("shape_y"), back("shape_y"))) / count)
    cm = F.sqrt(
        (squares(in_cm(fa, fa("shape_x")), in_cm(fb, back("shape_x"))) + squares(in_cm(fa, fa("shape_y")), in_cm(fb, back("shape_y")))) / count
    )
    la, lb = fa("length_cm"), fb("length_cm")

    def share(values: Column) -> Column:
        return pl.let(F.transform(values, lambda v: v + EPS), lambda p: pl.let(pl.total(p), lambda s: F.transform(p, lambda v: v / s)))

    def divergence(p: Column, q: Column) -> Column:
        half = lambda u, v: F.zip_with(u, v, lambda x, y: x * F.log(x / (0.5 * (x + y))))
        return 0.5 * (pl.total(half(p, q)) + pl.total(half(q, p)))

    histogram = pl.let(F.struct(share(fa("histogram")).alias("p"), share(fb("histogram")).alias("q")), lambda h: divergence(h["p"], h["q"]))
    parts = {
        "shape": shape,
        "fourier": F.sqrt(squares(fa("fourier"), fb("fourier"))),
        "length": F.when((la > 0) & (lb > 0), F.abs(la - lb) / F.greatest(la, lb)).otherwise(F.lit(1.0)),
        "cm_shape": F.coalesce(cm, F.lit(1.0)),
        "histogram": histogram,
    }
    score = F.lit(0.0)
    for name, part in parts.items():
        score = score + WEIGHTS[name] * part
    return {**parts, "score": F.round(score, SCORE_PLACES)}


def confidence(score: Column) -> Column:
    return 1.0 / (1.0 + score)


#: The names under which the parts are stored.
STORED_PARTS = {
    "shape": "shape_score", "fourier": "fourier_score", "length": "scale_length_penalty", "cm_shape": "scale_shape_score", "histogram": "histogram_distance",
}


def score_details(similarity: Column | None = None, overlap: Column | None = None) -> Column:
    """Map of the score's parts by their stored names, rounded to six places; similarity and overlap 0 where absent."""
    zero = F.lit(0.0)
    entries = {stored: F.col(n) for n, stored in STORED_PARTS.items()} | {
        "embedding_similarity": zero if similarity is None else F.coalesce(similarity, zero),
        "overlap_ratio": zero if overlap is None else F.coalesce(overlap, zero),
    }
    return F.create_map(*[x for n, c in entries.items() for x in (F.lit(n), F.round(c, 6))])


# ---- first-generation matcher --------------------------------------------------------------------------


def match_target(edges: DataFrame, target: str, k: int = 3) -> DataFrame:
    """Every torn edge of one fragment against all other fragments' edges: the smallest distance to the
    negated edge over four orientations, plus half the length gap.

    ``edges`` has ``fragment_id, side, shape_x, shape_y, length``.  A fragment has at most four such
    edges (one per side); they travel as one small array, and each candidate row is scored where it is.
    """
    own = edges.filter(F.col("fragment_id") == target).agg(F.collect_list(F.struct("side", "shape_x", "shape_y", "length")).alias("own"))
    pairs = edges.filter(F.col("fragment_id") != target).withColumn("t", F.explode(own.scalar()))

    def gap(x: Column, y: Column, sx: float, sy: float) -> Column:
        along = lambda u, v, s: pl.total(F.zip_with(u, v, lambda p, q: (p - s * q) * (p - s * q)))
        return F.sqrt((along(F.col("t.shape_x"), x, sx) + along(F.col("t.shape_y"), y, sy)) / (F.size(x) * 2))

    x, y = F.col("shape_x"), F.col("shape_y")
    best = F.least(
        gap(x, y, -1.0, -1.0), gap(x, y, 1.0, -1.0), gap(F.reverse(x), F.reverse(y), -1.0, -1.0), gap(F.reverse(x), F.reverse(y), 1.0, -1.0)
    )
    longest = F.greatest(F.col("t.length"), F.col("length"), F.lit(1e-6))
    score = F.round(best + 0.5 * F.abs(F.col("t.length") - F.col("length")) / longest, SCORE_PLACES)
    scored = pairs.select(F.col("t.side").alias("target_side"), "fragment_id", "side", score.alias("score"))
    return keep_best(scored, "target_side", k, ["score", "fragment_id", "side"])


# ---- nearest embeddings (the formula is ours: exact cosine similarity) ---------------------------------------


def embedding_candidates(vectors: DataFrame, k: int = 50, rows: int = 4096) -> DataFrame:
    """The ``k`` most similar other items of every item of ``(item, vector)``, exact.

    Only the contract of this step is known; cosine similarity is our choice.  Vectors that are NULL, empty or
    hold NULL or non-finite elements take no part; vectors of different lengths do not meet.
    """

    def score(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        b, ends = candidates["item"].to_numpy(), unit(_matrix(candidates["vector"])).T if len(candidates) else None
        tiles = [tile(q["item"].to_numpy(), unit(_matrix(q["vector"])), b, ends) for q in _tiles(queries, candidates)]
        none = pd.DataFrame({"item": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "similarity": pd.Series(dtype=float)})
        return pd.concat(tiles) if tiles else none

    def tile(a: np.ndarray, starts: np.ndarray, b: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        like = np.round(starts @ ends, SCORE_PLACES)
        like[a[:, None] == b[None, :]] = -np.inf
        # only what reaches the k-th best of its row is sorted, ties with it included
        least = np.partition(like, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(a), -np.inf)
        i, j = np.nonzero(like >= least[:, None])
        order = np.lexsort((b[j], -like[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(a)))
        kept = np.arange(len(i)) - first[i] < k
        found = pd.DataFrame({"item": a[i[kept]], "other": b[j[kept]], "similarity": like[i[kept], j[kept]]})
        return found[np.isfinite(found["similarity"])]

    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = vectors.filter((F.size("vector") > 0) & finite).withColumn("__length", F.size("vector"))
    scored = meet_blocks(whole, ["__length"], "item", score, "item long, other long, similarity double", rows=rows, best=("item", k, {"similarity": False, "other": True}))
    return keep_best(scored, "item", k, [F.col("similarity").desc(), "other"])


# ---- placement and overlap ---------------------------------------------------------------------------------------

_OPPOSITE = [("left", "right"), ("right", "left"), ("top", "bottom"), ("bottom", "top")]
_PLACEMENT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("relative_x_cm", "relative_y_cm", "rotation_deg", "alignment_error")])


def fit_similarities(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For every row of complex points the shift, turn and scale that bring ``dst`` onto ``src``, in closed
    form: columns x, y, degrees and the mean distance left."""
    middle = lambda z: z.mean(axis=1, keepdims=True)
    s, d = src - middle(src), dst - middle(dst)
    ss, ds = (np.sqrt((np.abs(z) ** 2).mean(axis=1)) for z in (s, d))
    turn = np.exp(1j * np.angle((s * np.conj(d)).sum(axis=1))) * np.divide(ss, ds, out=np.ones_like(ss), where=ds > 0)
    shift = middle(src)[:, 0] - turn * middle(dst)[:, 0]
    left = np.abs(src - (turn[:, None] * dst + shift[:, None])).mean(axis=1)
    return np.column_stack((shift.real, shift.imag, np.degrees(np.angle(turn)), left))


def place_polylines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best fit of each row of ``b`` onto the row of ``a`` over cyclic shifts of a tenth of the points."""
    n = a.shape[1]
    best = fit_similarities(a, b)
    for shift in range(max(1, n // 10), n, max(1, n // 10)):
        fit = fit_similarities(a, np.roll(b, shift, axis=1))
        better = fit[:, 3] < best[:, 3]
        best[better] = fit[better]
    return best


def _even(points: np.ndarray, n: int) -> np.ndarray | None:
    along = np.concatenate(([0.0], np.cumsum(np.abs(np.diff(points)))))
    if len(points) < 2 or along[-1] == 0:
        return points[:n] if len(points) else None
    target = np.linspace(0, along[-1], n)
    return np.interp(target, along, points.real) + 1j * np.interp(target, along, points.imag)


@F.pandas_udf(_PLACEMENT)
def _place(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, flip: pd.Series) -> pd.DataFrame:
    out = np.full((len(ax), 4), np.nan)
    by_size: dict[int, list[tuple]] = {}
    for row, (x, y, u, v, turned) in enumerate(zip(ax, ay, bx, by, flip)):
        n = min(len(x), len(u), 50)
        a, b = _even(np.asarray(x) + 1j * np.asarray(y), n), _even(np.asarray(u) + 1j * np.asarray(v), n)
        if n >= 2 and a is not None and b is not None and len(a) == len(b) == n:
            by_size.setdefault(n, []).append((row, a, b[::-1] if turned else b))
    for group in by_size.values():  # nearly always one size, 50
        rows, a, b = zip(*group)
        out[list(rows)] = place_polylines(np.stack(a), np.stack(b))
    frame = pd.DataFrame(out, columns=[f.name for f in _PLACEMENT.fields]).astype(object)
    return frame.where(frame.notna(), None)


def placement(a: str, b: str) -> Column:
    """Where b's origin lies in a's frame, in centimetres, and b's turn; ``a``, ``b`` are edge structs
    with ``cm_x, cm_y, position``.  Edges on opposite sides keep their direction, others are reversed."""
    opposite = F.lit(False)
    for pa, pb in _OPPOSITE:
        opposite = opposite | ((F.col(f"{a}.position") == pa) & (F.col(f"{b}.position") == pb))
    return _place(F.col(f"{a}.cm_x"), F.col(f"{a}.cm_y"), F.col(f"{b}.cm_x"), F.col(f"{b}.cm_y"), ~opposite)


def overlap_ratio(cell: float = 0.1):
    """Shared grid cells over the smaller fragment's cells, for outlines in centimetres and b's placement.

    Only the contract of this check is known; the formula is ours.
    """
    return lambda ax, ay, bx, by, dx, dy, turn: overlap_with(cell)(footprint(cell)(ax, ay), bx, by, dx, dy, turn)


def line_continuity(pairs: DataFrame, lines: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Adds ``continuity`` to ``pairs``: the share of text lines that go on across the seam, 0 without lines.

    ``pairs`` has ``fragment_a_id, fragment_b_id, pair_id, dy``; ``lines`` has ``fragment_id, line_id, centre``
    in centimetres.  Lines meet in an equi-join on the pair and a bin as wide as the tolerance.
    """
    slim = pairs.select("pair_id", "fragment_a_id", "fragment_b_id", "dy")
    place = lambda c: F.floor(c / tolerance)
    of_a = slim.join(lines.withColumnRenamed("fragment_id", "fragment_a_id"), "fragment_a_id").select(
        "pair_id", F.col("line_id").alias("line_a"), F.col("centre").alias("ca"),
        F.explode(F.array(*[place(F.col("centre")) + s for s in (-1, 0, 1)])).alias("bin"),
    )
    shifted = F.col("centre") + F.col("dy")
    of_b = slim.join(lines.withColumnRenamed("fragment_id", "fragment_b_id"), "fragment_b_id").select(
        F.col("pair_id").alias("__pair"), shifted.alias("cb"), place(shifted).alias("__bin")
    )
    near = (F.col("pair_id") == F.col("__pair")) & (F.col("bin") == F.col("__bin")) & (F.abs(F.col("ca") - F.col("cb")) <= tolerance)
    met = of_a.join(of_b, near, "left_semi").select("pair_id", "line_a").distinct().groupBy("pair_id").agg(F.count(F.lit(1)).alias("__met"))
    sizes = lines.groupBy("fragment_id").agg(F.count(F.lit(1)).alias("__n"))
    size = lambda letter: sizes.select(F.col("fragment_id").alias(f"fragment_{letter}_id"), F.col("__n").alias(f"__n{letter}"))
    joined = pairs.join(met, "pair_id", "left").join(size("a"), "fragment_a_id", "left").join(size("b"), "fragment_b_id", "left")
    longest = F.greatest(F.coalesce("__na", F.lit(0)), F.coalesce("__nb", F.lit(0)))
    share = F.coalesce(F.try_divide(F.coalesce("__met", F.lit(0)).cast("double"), longest), F.lit(0.0))
    return joined.withColumn("continuity", share).drop("__met", "__na", "__nb")


def join_score(geometric: Column, similarity: Column, continuity: Column, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> Column:
    """Final score, lower is better.  Only the contract is known; the weights are ours."""
    g, s, c = weights
    return g * geometric + s * (1.0 - F.coalesce(similarity, F.lit(0.0))) + c * (1.0 - F.coalesce(continuity, F.lit(0.0)))


# ---- the whole job -----------------------------------------------------------------------------------------------


def torn_outlines(contours: DataFrame, edges: DataFrame) -> DataFrame:
    """The outlines whose fragment has an edge: most may have none, and need not move to pairs."""
    return contours.join(edges.select("fragment_id").distinct(), "fragment_id", "left_semi")


def reconstruct(
    contours: DataFrame, k: int = 5, version: str = "2.0", candidates: DataFrame | None = None,
    lines: DataFrame | None = None, max_overlap: float = 0.25,
) -> DataFrame:
    """From outlines to ranked, placed matches.

    ``contours`` has ``id, fragment_id, xs, ys, image_width, image_height, pixels_per_unit, scale_unit,
    line_count, script_type``.  With ``candidates`` (``fragment_a_id, fragment_b_id, similarity``) only
    fragments that have candidates ask, only fragments named in a pair are searched, and of the best
    3k found only candidate pairs stay.  ``lines`` (``fragment_id, line_id, centre``) adds text-line
    continuity to the final score.
    """
    eligible = contours.filter(F.col("pixels_per_unit").isNotNull())
    described = ct.extract_edges(eligible).withColumn("asks", F.lit(True))
    if candidates is not None:
        asking = candidates.select(F.col("fragment_a_id").alias("fragment_id")).distinct().withColumn("__asks", F.lit(True))
        named = asking.select("fragment_id").union(candidates.select("fragment_b_id")).distinct()
        described = wide(described).join(named, "fragment_id", "left_semi").join(asking, "fragment_id", "left")
        described = described.withColumn("asks", F.coalesce("__asks", F.lit(False))).drop("__asks")
    # an edge is known by its fragment and name; the separator stands in neither
    edges = cut(described.withColumn("edge_id", F.concat_ws("\u001f", "fragment_id", "edge_name")))
    found = cut(find_matches(edges, 3 * k))

    def side(letter: str, *extra: str) -> DataFrame:
        return wide(edges.select(
            F.col("edge_id").alias(f"edge_{letter}"), F.struct("fragment_id", "edge_name", "position", "cm_x", "cm_y").alias(letter)
        ))

    outlines = torn_outlines(eligible, edges).select("fragment_id", ct.per_cm(F.col("pixels_per_unit"), F.col("scale_unit")).alias("r"), "xs", "ys")
    in_cm = lambda c: pl.let(F.col("r"), lambda r: F.transform(c, lambda v: v / r))
    whole = pl.hold(outlines, {"ox": in_cm("xs"), "oy": in_cm("ys")}).select("fragment_id", "ox", "oy")
    prints = whole.select(F.col("fragment_id").alias("fragment_a_id"), footprint()("ox", "oy").alias("print"))  # once for all its pairs
    moved = whole.withColumnRenamed("fragment_id", "fragment_b_id")
    placed = (
        found.join(side("a"), "edge_a").join(side("b"), "edge_b")
        .withColumn("place", placement("a", "b"))
        .select(
            F.col("a.fragment_id").alias("fragment_a_id"), F.col("a.edge_name").alias("edge_a_name"),
            F.col("b.fragment_id").alias("fragment_b_id"), F.col("b.edge_name").alias("edge_b_name"),
            "edge_a", "edge_b", "score", *WEIGHTS, "place.*",
        )
    )
    if candidates is not None:
        asked = candidates.select("fragment_a_id", "fragment_b_id", "similarity")
        placed = placed.join(asked, ["fragment_a_id", "fragment_b_id"], "left")
        wanted = F.col("similarity").isNotNull()
    else:
        placed = placed.withColumn("similarity", F.lit(None).cast("double"))
        wanted = F.lit(True)
    checked = placed.join(wide(prints), "fragment_a_id").join(wide(moved), "fragment_b_id").withColumn(
        "overlap", overlap_with()(*[F.col(c) for c in ("print", "ox", "oy", "relative_x_cm", "relative_y_cm", "rotation_deg")])
    ).drop("print", "ox", "oy")
    keep = wanted & F.col("relative_x_cm").isNotNull() & (F.col("overlap") <= max_overlap)
    ranked = rank_matches(checked, k, keep, tie="edge_b").withColumnRenamed("new_rank", "rank")
    if lines is not None:
        # the pairs meet their lines on both sides, so placement and overlap are kept rather than redone
        numbered = cut(ranked.withColumn("pair_id", F.concat_ws("\u001e", "edge_a", "edge_b")).withColumn("dy", F.col("relative_y_cm")))
        ranked = line_continuity(numbered, lines).drop("pair_id", "dy")
        final = join_score(F.col("score"), F.col("similarity"), F.col("continuity"))
        ranked = rerank(ranked, F.round(final, SCORE_PLACES), tie="edge_b").drop("score", "rank").withColumnsRenamed(
            {"new_score": "score", "new_rank": "rank"}
        )
    return ranked.select(
        "fragment_a_id", "edge_a_name", "fragment_b_id", "edge_b_name", "score", "rank", confidence(F.col("score")).alias("confidence"),
        score_details(F.col("similarity"), F.col("overlap")).alias("score_details"), "relative_x_cm", "relative_y_cm", "rotation_deg",
        F.lit(version).alias("algorithm_version"),
    )
