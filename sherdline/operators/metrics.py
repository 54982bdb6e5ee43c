"""Run statistics, evaluation metrics, data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from .ordering import at_quantile, join_on, running_max

SIDE_NAMES = ("top", "bottom", "left", "right")


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Quotient with a stated value for an empty denominator."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(empty).cast("double"))


def _rows(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


# ---- run and catalogue statistics -------------------------------------------------------------------


def processing_stats(fragments: DataFrame) -> DataFrame:
    status = F.col("processing_status")
    counted = fragments.agg(
        _rows().alias("total"), _rows(status == "completed").alias("completed"),
        _rows(status.isNull() | (status == "pending")).alias("pending"), _rows(status == "failed").alias("failed"),
    )
    return counted.withColumn("progress", ratio(F.col("completed") * 100.0, F.col("total")))


def last_processed(fragments: DataFrame) -> DataFrame:
    """Id of the completed row with the latest time; the higher id on equal times."""
    done = fragments.filter((F.col("processing_status") == "completed") & F.col("last_processed_at").isNotNull())
    return done.agg(F.max_by("id", F.struct("last_processed_at", "id")).alias("id"))


def duplicate_ids(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("fragment_id").agg(_rows().alias("n")).filter("n > 1")


REQUIRED = ("fragment_id", "image_path", "created_at")


def integrity_findings(fragments: DataFrame, listing: DataFrame, project_rows: DataFrame, matches: DataFrame) -> DataFrame:
    """All findings as ``(kind, item, detail)``: gaps, files, duplicates, orphans.

    ``listing`` has ``path, is_directory, size`` for the files there are.  Blank and NULL ids that occur
    more than once are duplicates like any other.  A row of ``project_rows`` or either side of a match
    whose fragment there is not is an orphan; ``item`` then names table, column and row.
    """

    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")) == "", F.lit(True))

    gaps = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in REQUIRED]))
    missing = fragments.withColumn("gaps", gaps).filter(F.size("gaps") > 0).select(
        F.lit("required").alias("kind"), F.col("id").cast("string").alias("item"), F.array_join("gaps", ",").alias("detail")
    )
    files = listing.select("path", "is_directory", "size", F.lit(True).alias("found"))
    reason = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("is_directory"), "is_directory")
        .when(F.col("size") == 0, "empty_file")
    )
    images = (
        fragments.filter(~blank("image_path"))
        .withColumn("path", normalize_path(F.col("image_path")))
        .join(files, "path", "left")
        .select(F.lit("image").alias("kind"), F.col("id").cast("string").alias("item"), reason.alias("detail"))
        .filter("detail IS NOT NULL")
    )
    repeated = duplicate_ids(fragments).select(
        F.lit("duplicate").alias("kind"), F.col("fragment_id").alias("item"), F.col("n").cast("string").alias("detail")
    )
    known = fragments.select("fragment_id").filter(F.col("fragment_id").isNotNull()).distinct()
    sides = [
        (project_rows, "project_fragments", "fragment_id", "row_id"),
        (matches, "edge_matches", "fragment_a_id", "match_id"),
        (matches, "edge_matches", "fragment_b_id", "match_id"),
    ]
    found = missing.unionByName(images).unionByName(repeated)
    for rows, table, column, row in sides:
        lost = rows.select(F.col(column).alias("fragment_id"), F.col(row).cast("string").alias("row")).join(known, "fragment_id", "left_anti")
        item = F.concat_ws(".", F.lit(table), F.lit(column), "row")
        found = found.unionByName(lost.select(F.lit("orphan").alias("kind"), item.alias("item"), F.col("fragment_id").alias("detail")))
    return found


def integrity_summary(findings: DataFrame) -> DataFrame:
    kind = F.col("kind")
    counted = findings.agg(
        *[_rows(kind == k).alias(f"{k}_findings") for k in ("required", "image", "duplicate", "orphan")], _rows().alias("findings")
    )
    return counted.withColumn("passed", F.col("findings") == 0)


def has_matches(matches: DataFrame) -> DataFrame:
    """One row ``has_matches, n``; a table that is not there comes from ``readers.read_or_empty``."""
    return matches.agg((_rows() > 0).alias("has_matches"), _rows().alias("n"))


def run_report(run: DataFrame, evaluation: DataFrame, max_hours: float = 1.15, min_success: float = 0.99) -> DataFrame:
    """``run`` has one row ``elapsed_seconds``; ``evaluation`` one row ``total, required_ok``."""
    joined = evaluation.withColumn("elapsed_seconds", run.select("elapsed_seconds").scalar())
    hours = F.coalesce("elapsed_seconds", F.lit(0.0)) / 3600
    success = ratio(F.col("required_ok").cast("double"), F.col("total"))
    return joined.select(
        F.round(hours, 4).alias("elapsed_hours"),
        F.round(success, 4).alias("success_rate"),
        F.round(ratio(F.col("required_ok").cast("double"), hours), 2).alias("throughput_per_hour"),
        ((hours > 0) & (hours <= max_hours)).alias("time_ok"),
        ((F.col("total") > 0) & (success >= min_success)).alias("success_ok"),
    )


def slo_report(oplog: DataFrame, within_ms: float = 500.0) -> DataFrame:
    """Per operation type: count, mean, nearest-rank 95th percentile, maximum, share in time, errors."""
    per_type = oplog.groupBy("op_type").agg(
        _rows().alias("n"), F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        (_rows(F.col("duration_ms") <= within_ms) / _rows()).alias("within_ratio"),
        (_rows(~F.col("ok")) / _rows()).alias("error_rate"),
    )
    p95 = at_quantile(oplog, ["op_type"], "duration_ms", "op_id", 0.95, "p95_ms")
    return per_type.join(p95, "op_type")


def slo_verdicts(report: DataFrame, search: str, canvas: str) -> DataFrame:
    """The four verdicts of the interactive workload; a type without operations counts as zero."""
    of = lambda kind, name: F.coalesce(F.max(F.when(F.col("op_type") == kind, F.col(name))), F.lit(0.0))
    errors = ratio(F.sum(F.col("error_rate") * F.col("n")), F.sum("n"))
    return report.agg(
        (of(search, "mean_ms") <= 2000).alias("mean_search_ok"), (of(search, "p95_ms") <= 3000).alias("p95_search_ok"),
        (of(canvas, "within_ratio") >= 0.95).alias("canvas_in_time_ok"), (errors <= 0.02).alias("error_rate_ok"),
    )


# ---- counts and detections -----------------------------------------------------------------------------


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(_rows().alias("n"))


def label_stats(df: DataFrame, value: str) -> DataFrame:
    """Images, total, mean, median, extremes and population deviation of line counts.

    Rows without a label are no images.  The median keeps a count per distinct value, of which line
    counts have few; the deviation is Spark's, which adds up moments about the mean.
    """
    v = F.col(value)
    return df.filter(v.isNotNull()).agg(
        _rows().alias("images"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
    )


def detection_summary(images: DataFrame, detections: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Per image: number of detections and their mean confidence (0 without any)."""
    per_image = detections.filter(F.col("confidence") >= min_confidence).groupBy("image_id").agg(
        _rows().alias("n"), F.avg("confidence").alias("mean_confidence")
    )
    return images.select("image_id").join(per_image, "image_id", "left").select(
        "image_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence")
    )


def detection_stats(images: DataFrame, detections: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Over all images: detections, their mean, least and greatest number, and the mean of the images'
    mean confidences, in which an image without detections counts with 0."""
    return detection_summary(images, detections, min_confidence).agg(
        _rows().alias("images"), _rows(F.col("n") > 0).alias("with_detections"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"),
        F.avg("n").alias("per_image"), F.min("n").alias("min_lines"), F.max("n").alias("max_lines"),
        F.avg("mean_confidence").alias("mean_confidence"),
    )


def detection_histogram(images: DataFrame, detections: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Number of images for each number of detections."""
    return histogram(detection_summary(images, detections, min_confidence), "n")


def line_count_accuracy(df: DataFrame) -> DataFrame:
    """``df`` has ``truth, predicted``."""
    error = (F.col("predicted") - F.col("truth")).cast("double")
    return df.agg(
        _rows().alias("images"), _rows(error == 0).alias("exact"), F.coalesce(F.avg((error == 0).cast("double")), F.lit(0.0)).alias("exact_accuracy"),
        F.coalesce(F.avg((F.abs(error) <= 1).cast("double")), F.lit(0.0)).alias("off_by_one_accuracy"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def error_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy((F.col("predicted") - F.col("truth")).alias("error")).agg(_rows().alias("n"))


def accuracy_by_truth(df: DataFrame) -> DataFrame:
    return df.groupBy("truth").agg(_rows().alias("n"), F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"))


def worst_counts(df: DataFrame, n: int = 5) -> DataFrame:
    off = F.abs(F.col("predicted") - F.col("truth"))
    return df.withColumn("off", off).orderBy(F.col("off").desc(), "image_id").limit(n)


# ---- classification ---------------------------------------------------------------------------------------


def confusion_matrix(df: DataFrame, labels: Sequence | None = None) -> DataFrame:
    """Counts for every (truth, predicted) pair of labels, zeros kept; other labels are left out.

    Without ``labels`` the label set is what occurs.  The grid is built from the aggregate.
    """
    counted = df.groupBy("truth", "predicted").agg(_rows().alias("n"))
    if labels is not None:
        known = F.array(*[F.lit(x) for x in labels])
        grid = df.sparkSession.range(1).select(F.explode(known).alias("truth"), known.alias("all"))
    else:
        seen = counted.select(F.explode(F.array("truth", "predicted")).alias("label")).filter("label IS NOT NULL")
        known = seen.agg(F.sort_array(F.collect_set("label")).alias("all"))
        grid = known.select(F.explode("all").alias("truth"), "all")
    grid = grid.select("truth", F.explode("all").alias("predicted"))
    return grid.join(counted, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def f1_of(precision: Column, recall: Column, empty: float | None = 0.0) -> Column:
    return F.when((precision + recall) > 0, 2.0 * precision * recall / (precision + recall)).otherwise(F.lit(empty).cast("double"))


def class_report(df: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, F1; zero division gives 0."""
    counted = df.groupBy("truth", "predicted").agg(_rows().alias("n"))
    sides = counted.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
    precision, recall = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    return totals.select(
        "label", "support", "hits", precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1")
    )


def multiclass_metrics(df: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the per-class rows."""
    weighted = lambda name: ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))
    return class_report(df).agg(
        F.sum("support").alias("n"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"),
    )


def _long_sides(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per side from columns ``t_<side>`` (truth) and ``p_<side>`` (probability or flag)."""
    sides = [
        F.struct(F.lit(s).alias("side"), F.col(f"t_{s}").alias("truth"), F.col(f"p_{s}").alias("p")) for s in SIDE_NAMES
    ]
    return df.select(*keep, F.explode(F.array(*sides)).alias("s")).select(*keep, "s.*")


def _cells(truth: Column, guess: Column) -> list[Column]:
    return [
        _rows(guess & truth).alias("tp"), _rows(~guess & ~truth).alias("tn"),
        _rows(guess & ~truth).alias("fp"), _rows(~guess & truth).alias("fn"),
    ]


def _with_rates(counts: DataFrame, empty: float | None) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + F.col("tn"), tp + F.col("tn") + fp + fn, empty),
            "precision": precision, "recall": recall, "f1": f1_of(precision, recall, empty),
        }
    )


def side_metrics(df: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Per side: confusion cells, accuracy, precision, recall, F1 at the side's threshold (0.5)."""
    cut_off = F.create_map(*[x for s in SIDE_NAMES for x in (F.lit(s), F.lit((thresholds or {}).get(s, 0.5)))])
    long = _long_sides(df)
    return _with_rates(long.groupBy("side").agg(*_cells(F.col("truth"), F.col("p") >= cut_off[F.col("side")])), 0.0)


def multilabel_summary(df: DataFrame, thresholds: Mapping[str, float] | None = None, piece: tuple[Column, Column] | None = None) -> DataFrame:
    """Exact match over all sides, accuracy over all labels, and piece accuracy where given."""
    right = [(F.col(f"p_{s}") >= (thresholds or {}).get(s, 0.5)) == F.col(f"t_{s}") for s in SIDE_NAMES]
    every, share = F.lit(True), F.lit(0.0)
    for r in right:
        every, share = every & r, share + r.cast("double")
    columns = [
        F.coalesce(F.avg(every.cast("double")), F.lit(0.0)).alias("exact_match"),
        F.coalesce(F.avg(share / len(right)), F.lit(0.0)).alias("micro_accuracy"),
    ]
    if piece is not None:
        columns.append(F.avg((piece[0] == piece[1]).cast("double")).alias("piece_accuracy"))
    return df.agg(*columns)


def annotation_side_metrics(df: DataFrame) -> DataFrame:
    """Per method and side, as :func:`side_metrics` on flags: only rows the method judged (``status`` ok)
    and sides that are labelled; NULL on zero division."""
    long = _long_sides(df.filter(F.col("status") == "ok"), ["method"]).filter(F.col("truth").isNotNull())
    return _with_rates(long.groupBy("method", "side").agg(_rows().alias("labelled"), *_cells(F.col("truth"), F.col("p"))), None)


def _judged(df: DataFrame) -> DataFrame:
    known, errors = F.lit(0), F.lit(0)
    for s in SIDE_NAMES:
        known = known + F.col(f"t_{s}").isNotNull().cast("int")
        errors = errors + F.coalesce((F.col(f"t_{s}") != F.col(f"p_{s}")).cast("int"), F.lit(0))
    return df.withColumn("known", known).withColumn("errors", errors)


def annotation_summary(df: DataFrame) -> DataFrame:
    """Per method: rows per outcome (``status`` is ok, segmentation or prediction; the last two are failures
    counted apart) and exact matches among judged rows with a label."""
    j = _judged(df)
    ok = F.col("status") == "ok"
    rated = ok & (F.col("known") > 0)
    return j.groupBy("method").agg(
        _rows().alias("samples"), _rows(ok).alias("evaluated"), _rows(F.col("status") == "segmentation").alias("segmentation_failures"),
        _rows(F.col("status") == "prediction").alias("prediction_failures"), _rows(rated).alias("rated"),
        _rows(rated & (F.col("errors") == 0)).alias("exact"),
        ratio(_rows(rated & (F.col("errors") == 0)), _rows(rated), None).alias("exact_accuracy"),
    )


def worst_annotations(df: DataFrame, n: int = 12) -> DataFrame:
    bad = _judged(df).filter((F.col("status") == "ok") & (F.col("errors") > 0))
    return bad.orderBy(F.col("errors").desc(), "path").limit(n)


CANDIDATE_THRESHOLDS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


def tune_thresholds(df: DataFrame, candidates: Sequence[float] = CANDIDATE_THRESHOLDS) -> DataFrame:
    """Per side the first of ``candidates``, in their order, with the best F1; 0.5 without rows.

    Each probability is counted once, under the number of thresholds it reaches; the cells of every
    threshold are sums over those few counts.
    """
    rising = sorted(enumerate(candidates), key=lambda x: x[1])
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(-i).alias("turn")) for i, t in rising])
    reached = F.size(F.filter(grid, lambda t: F.col("p") >= t["threshold"]))
    counts = _long_sides(df).groupBy("side", reached.alias("reached"), "truth").agg(_rows().alias("n"))
    tried = counts.select("*", F.posexplode(grid).alias("place", "tried"))
    yes = F.col("reached") > F.col("place")
    n_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    cells = tried.groupBy("side", "tried").agg(
        n_if(yes & F.col("truth")).alias("tp"), n_if(yes & ~F.col("truth")).alias("fp"),
        n_if(~yes & F.col("truth")).alias("fn"), n_if(~yes & ~F.col("truth")).alias("tn"),
    )
    best = _with_rates(cells, 0.0).groupBy("side").agg(
        F.max(F.struct(F.col("f1"), F.col("tried.turn").alias("turn"), F.col("tried.threshold").alias("threshold"))).alias("best")
    )
    sides = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SIDE_NAMES])).alias("side"))
    return sides.join(best, "side", "left").select("side", F.coalesce("best.threshold", F.lit(0.5)).alias("threshold"), F.col("best.f1").alias("f1"))


def aggregate_seeds(results: DataFrame) -> DataFrame:
    """``results`` has ``method, seed, metric, value``; mean and population deviation over the seeds."""
    return results.groupBy("method", "metric").agg(
        _rows().alias("seeds"), F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std")
    )


# ---- samples, weights, reviews ---------------------------------------------------------------------------


def split_summary(samples: DataFrame) -> DataFrame:
    """``samples`` has ``split, collection``, the four sides and ``piece_type``."""
    per_collection = samples.groupBy("split", "collection").agg(
        _rows().alias("n"),
        *[_rows(F.col(f"has_{s}_edge")).alias(s) for s in SIDE_NAMES],
        *[_rows(F.col("piece_type") == p).alias(p) for p in ("interior", "edge", "corner")],
    )
    return per_collection.groupBy("split").agg(
        F.sum("n").alias("count"), _rows().alias("collections"),
        *[F.sum(c).alias(c) for c in (*SIDE_NAMES, "interior", "edge", "corner")],
    )


def class_weights(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Per class ``N / (K * n)`` and the sampling weight ``1 / n``; a class without rows counts as one row."""
    counts = df.groupBy(F.col(label).alias("label")).agg(_rows().alias("n"))
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    total = Window.partitionBy(F.lit(0))  # one row per class
    per_class = wanted.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    size = F.greatest(F.col("n"), F.lit(1))
    return per_class.select(
        "label", "n", (F.sum("n").over(total) / (float(len(classes)) * size)).alias("weight"),
        (F.lit(1.0) / size).alias("sample_weight"),
    )


def pos_weights(df: DataFrame) -> DataFrame:
    """Per side negatives over positives, 1 without positives."""
    long = _long_sides(df)
    counts = long.groupBy("side").agg(_rows(F.col("truth")).alias("positives"), _rows(~F.col("truth")).alias("negatives"))
    return counts.withColumn("pos_weight", ratio(F.col("negatives"), F.col("positives"), 1.0))


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _corner() -> Column:
    total = F.lit(0)
    for s in SIDE_NAMES:
        total = total + _true(f"has_{s}_edge").cast("int")
    return total >= 2


def review_stats(annotations: DataFrame) -> DataFrame:
    return annotations.agg(
        _rows().alias("total"), _rows(_true("reviewed")).alias("reviewed"), _rows(_true("skipped")).alias("skipped"),
        _rows(~_true("reviewed")).alias("remaining"),
    )


def reviewed_by_collection(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("collection").agg(_rows(_true("reviewed")).alias("reviewed"))


def positive_labels(flags: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per label that holds: the four sides, and ``corner`` for two or more."""
    tests = [F.when(_true(f"has_{s}_edge"), F.lit(s)) for s in SIDE_NAMES] + [F.when(_corner(), F.lit("corner"))]
    return flags.select(*keep, F.explode(F.array_compact(F.array(*tests))).alias("label"))


def target_summary(annotations: DataFrame, predictions: DataFrame, images: DataFrame) -> DataFrame:
    """Per label: positives among reviewed, unskipped annotations, and predicted positives among the images at
    hand.  ``predictions`` has the sides by ``path``, ``images`` the ``path`` of each image."""
    reviewed = positive_labels(annotations.filter(_true("reviewed") & ~_true("skipped"))).groupBy("label").agg(_rows().alias("reviewed_positives"))
    at_hand = images.select(normalize_path(F.col("path")).alias("__path")).distinct()
    predictions = predictions.withColumn("__path", normalize_path(F.col("path"))).join(at_hand, "__path", "left_semi")
    predicted = positive_labels(predictions).groupBy("label").agg(_rows().alias("predicted_positives"))
    labels = annotations.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in (*SIDE_NAMES, "corner")])).alias("label")
    )
    joined = labels.join(reviewed, "label", "left").join(predicted, "label", "left")
    return joined.na.fill(0, ["reviewed_positives", "predicted_positives"])


def auto_targets(summary: DataFrame, n: int = 3) -> DataFrame:
    """Labels to look for next: fewest reviewed, then most predicted, then name."""
    return (
        summary.filter("predicted_positives > 0")
        .orderBy("reviewed_positives", F.col("predicted_positives").desc(), "label")
        .limit(n)
    )


def best_checkpoint(history: DataFrame, patience: int) -> DataFrame:
    """Per run: best epoch and score until training stops, and the epoch it stops at.

    ``history`` has ``run, epoch, score``.  An epoch is new best when it beats all before it;
    training stops at the first epoch that is ``patience`` past the last best.  Many runs at once,
    and a long run is handled block by block.
    """
    seen = running_max(history, ["run"], "epoch", F.col("score"), "__before", inclusive=False)
    fresh = F.col("__before").isNull() | (F.col("score") > F.col("__before"))
    marked = seen.withColumn("best_so_far", F.when(fresh, F.col("epoch")))
    lasting = running_max(marked, ["run"], "epoch", F.col("best_so_far"), "__last", inclusive=True)
    stops = lasting.withColumn("__stop", F.when(F.col("epoch") - F.col("__last") >= patience, F.col("epoch")))
    first = stops.groupBy("run").agg(F.min("__stop").alias("stop_epoch"))
    running = join_on(stops, first, ["run"]).filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return running.groupBy("run").agg(
        F.max("best_so_far").alias("best_epoch"), F.max("score").alias("best_score"),
        F.first("stop_epoch").alias("stop_epoch"), F.count("best_so_far").alias("improvements"),
    )


def layout_bounds(project_fragments: DataFrame) -> DataFrame:
    right, low = F.col("x") + F.col("width") * F.col("scale_x"), F.col("y") + F.col("height") * F.col("scale_y")
    boxes = project_fragments.groupBy("project_id").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(right).alias("max_x"), F.max(low).alias("max_y")
    )
    return boxes.withColumn("centre_x", (F.col("min_x") + F.col("max_x")) / 2).withColumn("centre_y", (F.col("min_y") + F.col("max_y")) / 2)


def clip_and_filter_classes(df: DataFrame, label: str, highest: int, min_rows: int = 2) -> DataFrame:
    """Labels held to 0..highest, then classes with too few rows dropped."""
    clipped = df.withColumn(label, F.least(F.greatest(F.col(label), F.lit(0)), F.lit(highest)))
    enough = clipped.groupBy(label).agg(_rows().alias("__n")).filter(F.col("__n") >= min_rows).select(label)
    return clipped.join(enough, label, "left_semi")
