"""Column functions on polylines held as two arrays, ``xs`` and ``ys``.

A contour is one value of one row, so its geometry needs no shuffle: array functions run where the
row is.  ``let`` binds an intermediate array once, instead of once per element of a later lambda.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As ``withColumns``, behind a one-element explode: the optimizer then keeps the arrays as they
    are and does not fold their expressions into later lambdas, where they would run per element."""
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.explode(F.array(made)).alias("__held")).select(
        *kept, *[F.col(f"__held.{n}").alias(n) for n in columns]
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def indices(n: Column) -> Column:
    """0..n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def rolled(values: Column, k: int) -> Column:
    """Circular shift: element i of the result is element (i + k) mod n; |k| must be at most n."""
    if k >= 0:
        return F.concat(F.slice(values, k + 1, F.size(values)), F.slice(values, 1, k))
    return F.concat(F.slice(values, k, -k), F.slice(values, F.lit(1), F.size(values) + k))


def differences(values: Column) -> Column:
    ahead = F.slice(values, F.lit(2), F.size(values))
    behind = F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.zip_with(ahead, behind, lambda a, b: a - b)


def _norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def step_lengths(xs: Column, ys: Column) -> Column:
    return F.zip_with(differences(xs), differences(ys), _norm)


def path_length(xs: Column, ys: Column) -> Column:
    return total(step_lengths(xs, ys))


def chord(xs: Column, ys: Column) -> Column:
    last = F.lit(-1)
    return _norm(F.element_at(xs, last) - F.element_at(xs, 1), F.element_at(ys, last) - F.element_at(ys, 1))


def straightness(xs: Column, ys: Column) -> Column:
    """Path length over chord, infinite for a closed path."""
    return let(chord(xs, ys), lambda c: F.when(c > 0, path_length(xs, ys) / c).otherwise(F.lit(float("inf"))))


def area(xs: Column, ys: Column) -> Column:
    """Absolute shoelace area of the closed polygon."""
    across = F.zip_with(xs, rolled(ys, 1), lambda x, y: x * y)
    back = F.zip_with(rolled(xs, 1), ys, lambda x, y: x * y)
    return F.abs(total(F.zip_with(across, back, lambda a, b: a - b))) / 2.0


def moving_average(values: Column, window: int, passes: int = 1, whole_pixels: bool = False) -> Column:
    """Circular moving average; ``whole_pixels`` truncates after every pass."""
    window = max(1, window) | 1
    radius = window // 2
    if window == 1:
        return values

    def one_pass(given: Column) -> Column:
        padded = F.concat(F.slice(given, -radius, radius), given, F.slice(given, 1, radius))

        def smooth(p: Column) -> Column:
            # the windows of all cells grow together, so a cell costs an addition per step instead of a slice and a fold
            n = F.greatest(F.size(p) - 2 * radius, F.lit(0))
            at = lambda k: F.slice(p, F.lit(k + 1), n)
            sums = at(0)
            for k in range(1, window):
                sums = F.zip_with(sums, at(k), lambda s, v: s + v)
            cell = (lambda s: (s / float(window)).cast("int").cast("double")) if whole_pixels else (lambda s: s / float(window))
            return F.transform(sums, cell)

        return let(padded, smooth)

    smoothed = values
    for _ in range(passes):
        smoothed = let(smoothed, one_pass)
    return F.when(F.size(values) < window, values).otherwise(smoothed)


def _angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two vectors, NULL when either has no length."""
    norms = _norm(ax, ay) * _norm(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / norms))
    return F.when(norms > 0, F.acos(cosine))


def curvature(xs: Column, ys: Column, window: int = 11) -> Column:
    """pi minus the turning angle over half a window each way, circular; 0 where undefined.

    A straight run gives pi, so high values are straight runs; the corner finder builds on that.
    """
    half = window // 2

    def both(given: Column) -> tuple[Column, Column]:
        into = F.zip_with(given, rolled(given, -half), lambda p, b: p - b)
        out = F.zip_with(rolled(given, half), given, lambda f, p: f - p)
        return into, out

    ax, bx = both(xs)
    ay, by = both(ys)
    steps = F.arrays_zip(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    bent = F.transform(
        steps, lambda s: F.coalesce(F.lit(math.pi) - _angle_between(s["ax"], s["ay"], s["bx"], s["by"]), F.lit(0.0))
    )
    return F.when(F.size(xs) < window, F.transform(xs, lambda _: F.lit(0.0))).otherwise(bent)


def turning_angles(xs: Column, ys: Column) -> Column:
    """Angles at the interior points of an open polyline; points beside a zero step are left out."""

    def from_steps(d: Column) -> Column:
        n = F.greatest(F.size(d) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(d, F.lit(1), n), F.slice(d, F.lit(2), n), lambda a, b: _angle_between(a["x"], a["y"], b["x"], b["y"]))
        return F.array_compact(pairs)

    return let(F.arrays_zip(differences(xs).alias("x"), differences(ys).alias("y")), from_steps)


def complexity(xs: Column, ys: Column) -> Column:
    """Population deviation of the turning angles, 0 without any."""

    def deviation(a: Column) -> Column:
        return let(mean(a), lambda m: F.sqrt(mean(F.transform(a, lambda v: (v - m) * (v - m)))))

    return F.coalesce(let(turning_angles(xs, ys), deviation), F.lit(0.0))


def curvature_histogram(xs: Column, ys: Column, bins: int = 8) -> Column:
    """Shares of the turning angles in even bins over 0..pi, the last one closed; zeros without any."""

    def shares(a: Column) -> Column:
        place = F.transform(a, lambda v: F.least(F.floor(v / math.pi * bins), F.lit(bins - 1)))
        return let(
            place,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.lit(bins - 1)),
                lambda b: F.coalesce(F.try_divide(F.size(F.filter(p, lambda v: v == b)).cast("double"), F.size(p)), F.lit(0.0)),
            ),
        )

    return let(turning_angles(xs, ys), shares)


def centred(values: Column) -> Column:
    return let(mean(values), lambda m: F.transform(values, lambda v: v - m))


def moments(xs: Column, ys: Column) -> Column:
    """``struct<mx, my, sxx, syy, sxy>`` about the mean."""
    centre = F.struct(mean(xs).alias("mx"), mean(ys).alias("my"))

    def around(c: Column) -> Column:
        product = lambda a, ma, b, mb: total(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)))
        return F.struct(
            c["mx"].alias("mx"), c["my"].alias("my"),
            product(xs, c["mx"], xs, c["mx"]).alias("sxx"), product(ys, c["my"], ys, c["my"]).alias("syy"),
            product(xs, c["mx"], ys, c["my"]).alias("sxy"),
        )

    return let(centre, around)


def direction_of(m: Column) -> Column:
    """Principal direction from :func:`moments`, in -pi/2..pi/2."""
    return 0.5 * F.atan2(2.0 * m["sxy"], m["sxx"] - m["syy"])


def line_fit(xs: Column, ys: Column) -> Column:
    """``struct<err, angle>``: mean distance to the total-least-squares line, its angle folded to 0..90."""

    def fit(m: Column) -> Column:
        def residual(t: Column) -> Column:
            off = F.zip_with(xs, ys, lambda x, y: F.abs((x - m["mx"]) * F.sin(t) - (y - m["my"]) * F.cos(t)))
            return F.struct(mean(off).alias("err"), F.abs(F.degrees(t)).alias("angle"))

        return let(direction_of(m), residual)

    return let(moments(xs, ys), fit)


def arc(values: Column, start: Column, end: Column) -> Column:
    """Elements start..end of a circular array, both included; wraps when end is not after start."""
    n = F.size(values)
    straight = F.slice(values, start + 1, F.greatest(end - start + 1, F.lit(0)))
    wrapped = F.concat(F.slice(values, start + 1, n), F.slice(values, F.lit(1), end + 1))
    return F.when(end > start, straight).otherwise(wrapped)


def true_runs(mask: Column) -> Column:
    """Runs of true values as inclusive ``array<struct<a, b>>``."""

    def find(m: Column) -> Column:
        hit = lambda i: F.coalesce(F.get(m, i), F.lit(False))
        places = indices(F.size(m))
        starts = F.filter(places, lambda i: hit(i) & ((i == 0) | ~hit(i - 1)))
        ends = F.filter(places, lambda i: hit(i) & ~hit(i + 1))
        return F.arrays_zip(starts.alias("a"), ends.alias("b"))

    return let(mask, find)


def circular_runs(mask: Column) -> Column:
    """As :func:`true_runs`, with a run at the end and one at the start joined (then a > b)."""

    def join(runs: Column) -> Column:
        first, last = F.get(runs, F.lit(0)), F.get(runs, F.size(runs) - 1)
        touches = (F.size(runs) > 0) & (first["a"] == 0) & (last["b"] == F.size(mask) - 1)
        merged = F.array(F.struct(last["a"].alias("a"), first["b"].alias("b")))
        inner = F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 2, F.lit(0)))
        return F.when(touches, F.concat(merged, inner)).otherwise(runs)

    return let(true_runs(mask), join)


def span(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def linear_percentile(values: Column, q: float) -> Column:
    """Percentile with linear interpolation between the sorted values."""

    def pick(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low = F.get(s, F.floor(place).cast("int"))
        high = F.get(s, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return let(F.array_sort(values), pick)
