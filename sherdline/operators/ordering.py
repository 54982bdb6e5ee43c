"""Ranks and running values that hold up when one key owns a third of the rows.

A plain ``row_number() over (partition by key)`` sends a key to one task.  The helpers here split
every key into bounded pieces first, rank inside a piece, and add the sizes of the pieces before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other; the right key columns are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def seeded_hash(seed: str, *columns: Column) -> Column:
    """The md5 text that stands in for a seeded shuffle; both engines of the checks have it."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]))


def shuffle_rank(df: DataFrame, keys: Sequence[str], seed: str, item: str, out: str = "rank") -> DataFrame:
    """Adds the 1-based place of each row in a seeded shuffle inside its key, and the key's size.

    The first three hex digits of the hash cut every key into 4096 even pieces whatever its size,
    so the window below never sees more than 1/4096 of a hot key.
    """
    keys = list(keys)
    hashed = df.withColumn("__h", seeded_hash(seed, F.col(item)))
    hashed = hashed.withColumn("__piece", F.substring("__h", 1, 3))
    sizes = hashed.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # at most 4096 rows per key from here on
    sizes = sizes.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn(f"{out}_of", F.sum("__n").over(whole))
    inside = Window.partitionBy(*keys, "__piece").orderBy("__h", item)
    ranked = hashed.withColumn("__pos", F.row_number().over(inside))
    joined = join_on(ranked, sizes.drop("__n"), [*keys, "__piece"])
    return joined.withColumn(out, F.col("__before") + F.col("__pos")).drop("__h", "__piece", "__pos", "__before")


def sorted_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rank",
    pieces: int | None = None,
) -> DataFrame:
    """Adds the 1-based rank inside ``keys`` by ``order`` (which must be total) and the key's size.

    A range shuffle on (keys, order) spreads a hot key over many tasks.  The position of a row is its
    place in its own task plus the rows of the tasks before it, so no task holds a whole key.
    """
    keys = list(keys)
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_order = [F.col(k).asc_nulls_first() for k in keys]
    placed = df.repartitionByRange(pieces, *key_order, *order).sortWithinPartitions(*key_order, *order)
    placed = cut(placed.withColumn("__mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("__task", F.shiftright("__mid", _POSITION_BITS)).withColumn(
        "__pos", F.col("__mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    )
    tasks = placed.groupBy("__task").agg(F.count(F.lit(1)).alias("__rows"))
    running = Window.partitionBy(F.lit(0)).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(
        "__task",
        F.coalesce(F.sum("__rows").over(running), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(F.lit(0))).alias("__total"),
    )
    placed = placed.join(tasks, "__task").withColumn("__global", F.col("__before") + F.col("__pos"))
    if keys:
        starts = placed.groupBy(*keys).agg(
            F.min("__global").alias("__start"), F.count(F.lit(1)).alias(f"{out}_of")
        )
        placed = join_on(placed, starts, keys)
    else:
        placed = placed.withColumn("__start", F.lit(0)).withColumn(f"{out}_of", F.col("__total"))
    return placed.withColumn(out, F.col("__global") - F.col("__start") + 1).drop(
        "__mid", "__task", "__pos", "__before", "__total", "__global", "__start"
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Replaces every column of ``values`` by its running sum inside ``keys`` (none of them NULL) by ``order``, own row included.

    A range shuffle on (keys, order) spreads a hot key over many tasks.  A row's sum is that of its task's
    rows of the key so far plus what the tasks before hold of the key, so no window sees more than one
    task's rows, or one row per task.
    """
    keys, order = list(keys), list(order)
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(pieces, *keys, *order).withColumn("__task", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "__task").agg(*[F.sum(v).alias(f"__of_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__task", *[F.sum(f"__of_{v}").over(earlier).alias(f"__before_{v}") for v in values])
    inside = Window.partitionBy(*keys, "__task").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({v: F.sum(v).over(inside) for v in values}).join(
        before.filter(F.col(f"__before_{values[0]}").isNotNull()), [*keys, "__task"], "left"
    )
    return summed.select(
        *[(F.col(c) + F.coalesce(f"__before_{c}", F.lit(0))).alias(c) if c in values else F.col(c) for c in df.columns]
    )


def running_max(df: DataFrame, keys: Sequence[str], step: str, value: Column, out: str, inclusive: bool, block: int = 10_000) -> DataFrame:
    """Running maximum of ``value`` by the integer column ``step`` inside ``keys``.

    Steps are cut into blocks; a block's own maximum is folded into the blocks after it, so the
    windows see one block, or one row per block, and never a whole key.
    """
    keys = list(keys)
    cut_up = df.withColumn("__v", value).withColumn("__block", F.floor(F.col(step) / F.lit(float(block))))
    tops = cut_up.groupBy(*keys, "__block").agg(F.max("__v").alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__carried", F.max("__top").over(before)).drop("__top")
    inside = Window.partitionBy(*keys, "__block").orderBy(step).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    joined = join_on(cut_up, tops, [*keys, "__block"])
    return joined.withColumn(out, F.greatest("__carried", F.max("__v").over(inside))).drop("__v", "__block", "__carried")


_CELLS = 4096  # cells that a value range is cut into
_FEW_ROWS = 10_000
_CROWD = 100_000  # rows of a cell whose distinct values are counted as they are
_STEPS = 6  # cuts after which a cell holds but one double


def _cell(value: Column, low: Column, high: Column) -> Column:
    """The cell of ``low..high`` that holds a value; a greater value is never in an earlier cell."""
    value, low, high = value / 2, low / 2, high / 2  # the range itself may exceed the doubles
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.floor(share * _CELLS), F.lit(_CELLS - 1)).cast("int")


def _magnitude(value: Column) -> Column:
    """Cells of a 64th of a doubling, in the order of the values: NULL, least, negative, zero, positive, greatest, NaN."""
    size = F.abs(value)
    place = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * 64).cast("int") + 100_000
    finite = F.when(value > 0, place).when(value < 0, -place).otherwise(F.lit(0))
    return F.when(value.isNull(), -300_000).when(F.isnan(value), 300_000).when(size == float("inf"), F.when(value > 0, 200_000).otherwise(-200_000)).otherwise(finite)


def _holding(cells: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """The cell of each wanted rank: keys, rank, what is left of the rank inside the cell, and the cell's columns."""
    before = Window.partitionBy(*keys, "rank").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = (F.col("__left") > F.col("__before")) & (F.col("__left") <= F.col("__before") + F.col("__n"))
    return counted.filter(inside).withColumn("__left", F.col("__left") - F.col("__before")).drop("__before")


def _settled(small: DataFrame) -> tuple[DataFrame, bool | None]:
    """Cells of ranks, and whether one is crowded by several values.  At most ``_FEW_ROWS`` are worked out now and
    go on as literal rows, whose size Spark knows; more stay a plan, of which that is not known."""
    rows = small.limit(_FEW_ROWS + 1).toArrow()
    if rows.num_rows > _FEW_ROWS:
        return small, None
    crowded = any(n > _CROWD and low is not None and low < high for n, low, high in zip(*(rows[c].to_pylist() for c in ("__n", "__low", "__high"))))
    return small.sparkSession.createDataFrame(rows, small.schema), crowded


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """``keys, rank, value`` for each of the 1-based ranks that ``ranks`` (an array of longs over the key's size ``n``) names.

    Values, cast to double, rise from NULL to NaN.  No row is sorted or moved: counts by magnitude tell which cell
    holds the rank, passes over that cell cut its range by 4096 each while it is crowded, and a last one counts the
    distinct values that are left.  A pass sends at most its cells for each key and task.  The passes but the last
    run while the query is built.  Beyond 10,000 keys and ranks two cuts are made in any case, and Spark may also
    move the rows to the cells they meet.
    """
    keys = list(keys)
    slim = df.select(*keys, F.col(value).cast("double").alias("__v"))
    spread = [F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")]
    cells = slim.groupBy(*keys, _magnitude(F.col("__v")).alias("__cell")).agg(*spread)
    sized = cells.withColumn("n", F.sum("__n").over(Window.partitionBy(*keys))).withColumn("rank", F.explode(F.array_distinct(ranks)))
    chosen, crowded = _settled(_holding(sized.drop("n").withColumn("__left", F.col("rank")), keys, "__cell"))
    path = ["__cell"]
    rows = slim.withColumn("__cell", _magnitude(F.col("__v")))
    for step in range(_STEPS):
        if crowded is False or (crowded is None and step == 2):
            break
        name = f"__cell{step}"
        bounds = chosen.select(*keys, *path, "__low", "__high").distinct()
        rows = join_on(rows, bounds, [*keys, *path]).withColumn(name, F.coalesce(_cell(F.col("__v"), F.col("__low"), F.col("__high")), F.lit(0)))
        rows = rows.drop("__low", "__high")
        path.append(name)
        cells = rows.groupBy(*keys, *path).agg(*spread)
        chosen, crowded = _settled(_holding(join_on(cells, chosen.select(*keys, *path[:-1], "rank", "__left"), [*keys, *path[:-1]]), keys, name))
    left = join_on(rows, chosen.select(*keys, *path).distinct(), [*keys, *path]).groupBy(*keys, *path, "__v").agg(F.count(F.lit(1)).alias("__n"))
    found = _holding(join_on(left, chosen.select(*keys, *path, "rank", "__left"), [*keys, *path]), keys, "__v")
    return found.select(*keys, "rank", F.col("__v").alias(value))


def at_quantile(df: DataFrame, keys: Sequence[str], value: str, item: str, q: float, out: str) -> DataFrame:
    """Nearest-rank quantile per key, as a double; NULL values are the least.  ``item`` names the rows; equal values need no order."""
    rank = F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1))
    return select_ranks(df, keys, value, F.array(rank)).select(*keys, F.col(value).alias(out))


def median_of(df: DataFrame, keys: Sequence[str], value: str, item: str, out: str) -> DataFrame:
    """Exact median per key from the one or two middle ranks; NULL values are the least, and left out of a mean of two."""
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2))
    return select_ranks(df, keys, value, middle).groupBy(*keys).agg(F.avg(value).alias(out))
