"""Statistics, evaluation and data quality over the fragment views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import relations as rel
from .registry import query


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


@query("processing_stats", "E1", """SELECT count(*) AS total, count(*) FILTER (processing_status = 'completed') AS completed,
count(*) FILTER (processing_status IS NULL OR processing_status = 'pending') AS pending, count(*) FILTER (processing_status = 'failed') AS failed,
round(count(*) FILTER (processing_status = 'completed') * 100 / CAST(count(*) AS DOUBLE), 6) AS progress FROM fragments_v""")
def processing_stats(src):
    return rounded(mt.processing_stats(src("fragments_v")), "progress")


@query("last_processed", "E2", "SELECT id FROM catalogue_v WHERE last_processed_at IS NOT NULL ORDER BY last_processed_at DESC, id DESC LIMIT 1")
def last_processed(src):
    return mt.last_processed(src("catalogue_v"))


_FAULTY = """SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN '  ' WHEN id % 60 = 1 THEN 'OR_DOUBLE' || CAST(id % 7 AS VARCHAR(20)) ELSE fragment_id END AS fragment_id,
CASE WHEN id % 70 = 0 THEN NULL WHEN id % 71 = 0 THEN '' ELSE image_path END AS image_path, CASE WHEN id % 80 = 0 THEN NULL ELSE created_at END AS created_at FROM {catalogue_v}"""
_FAULTY_SQL = _FAULTY.replace("{", "").replace("}", "")


def _faulty(src):
    return src.spark.sql(_FAULTY, catalogue_v=src("catalogue_v"))


def _findings(src):
    listing = src("fragments_v").filter("id % 90 <> 7").selectExpr(
        "image_path AS path", "id % 100 = 3 AS is_directory", "CASE WHEN id % 110 = 5 THEN 0 ELSE id + 1 END AS size"
    )
    return mt.integrity_findings(_faulty(src), listing, src("project_fragments_v"), src("matches_v"))


_FINDINGS = f"""WITH faulty AS ({_FAULTY_SQL}) SELECT 'required' AS kind, CAST(id AS VARCHAR) AS item, concat_ws(',', CASE WHEN coalesce(trim(fragment_id), '') = '' THEN 'fragment_id' END,
 CASE WHEN coalesce(trim(image_path), '') = '' THEN 'image_path' END, CASE WHEN created_at IS NULL THEN 'created_at' END) AS detail
FROM faulty WHERE coalesce(trim(fragment_id), '') = '' OR coalesce(trim(image_path), '') = '' OR created_at IS NULL
UNION ALL SELECT 'image', CAST(id AS VARCHAR), CASE WHEN id % 90 = 7 THEN 'missing' WHEN id % 100 = 3 THEN 'is_directory' ELSE 'empty_file' END
FROM faulty WHERE coalesce(image_path, '') <> '' AND (id % 90 = 7 OR id % 100 = 3 OR id % 110 = 5)
UNION ALL SELECT 'duplicate', fragment_id, CAST(count(*) AS VARCHAR) FROM faulty GROUP BY fragment_id HAVING count(*) > 1
UNION ALL SELECT 'orphan', 'project_fragments.fragment_id.' || row_id, pf.fragment_id FROM project_fragments_v pf LEFT JOIN faulty f ON f.fragment_id = pf.fragment_id WHERE f.fragment_id IS NULL
UNION ALL SELECT 'orphan', 'edge_matches.fragment_a_id.' || match_id, em.fragment_a_id FROM matches_v em LEFT JOIN faulty f ON f.fragment_id = em.fragment_a_id WHERE f.fragment_id IS NULL
UNION ALL SELECT 'orphan', 'edge_matches.fragment_b_id.' || match_id, em.fragment_b_id FROM matches_v em LEFT JOIN faulty f ON f.fragment_id = em.fragment_b_id WHERE f.fragment_id IS NULL"""


@query("duplicate_ids", "E3", f"SELECT fragment_id, count(*) AS n FROM ({_FAULTY_SQL}) q GROUP BY fragment_id HAVING count(*) > 1")
def duplicate_ids(src):
    return mt.duplicate_ids(_faulty(src))


@query("integrity_findings", "E4", _FINDINGS)
def integrity_findings(src):
    return _findings(src)


@query("integrity_summary", "E4", f"""SELECT count(*) FILTER (kind = 'required') AS required_findings, count(*) FILTER (kind = 'image') AS image_findings,
count(*) FILTER (kind = 'duplicate') AS duplicate_findings, count(*) FILTER (kind = 'orphan') AS orphan_findings, count(*) AS findings, count(*) = 0 AS passed FROM ({_FINDINGS}) f""")
def integrity_summary(src):
    return mt.integrity_summary(_findings(src))


@query("has_matches", "E5", "SELECT count(*) > 0 AS has_matches, count(*) AS n FROM matches_v")
def has_matches(src):
    return mt.has_matches(src("matches_v"))


@query("run_report", "E6 D7", """SELECT round(s / 3600, 4) AS elapsed_hours, round(ok / n, 4) AS success_rate, round(ok / (s / 3600), 2) AS throughput_per_hour,
s / 3600 <= 1.15 AS time_ok, ok / n >= 0.99 AS success_ok FROM (SELECT (SELECT round(sum(value), 2) / 100 FROM events) AS s,
(SELECT CAST(count(*) AS DOUBLE) FROM fragments_v WHERE line_count IS NOT NULL) AS ok, (SELECT CAST(count(*) AS DOUBLE) FROM fragments_v) AS n) q""")
def run_report(src):
    run = src("events").agg((F.round(F.sum("value"), 2) / 100).alias("elapsed_seconds"))
    return mt.run_report(run, rel.completeness(src("fragments_v"), src("fragments_v").select("id"), ["line_count"], ["completed"]))


_SLO = """SELECT op_type, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms, max(duration_ms) AS max_ms, round(avg(CASE WHEN duration_ms <= 100 THEN 1 ELSE 0 END), 6) AS within_ratio,
round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 6) AS error_rate, max(CASE WHEN place = ceil(0.95e0 * total) THEN duration_ms END) AS p95_ms FROM (
SELECT *, row_number() OVER (PARTITION BY op_type ORDER BY duration_ms, op_id) AS place, count(*) OVER (PARTITION BY op_type) AS total FROM oplog_v) q GROUP BY op_type"""


@query("slo_report", "E7", _SLO)
def slo_report(src):
    report = mt.slo_report(src("oplog_v"), within_ms=100.0)
    return rounded(rounded(report, "mean_ms", places=4), "within_ratio", "error_rate")


@query("slo_verdicts", "E7", f"""SELECT max(CASE WHEN op_type = 'view' THEN mean_ms END) <= 2000 AS mean_search_ok, max(CASE WHEN op_type = 'view' THEN p95_ms END) <= 3000 AS p95_search_ok,
max(CASE WHEN op_type = 'click' THEN within_ratio END) >= 0.95 AS canvas_in_time_ok, sum(error_rate * n) / sum(n) <= 0.02 AS error_rate_ok FROM ({_SLO}) r""")
def slo_verdicts(src):
    return mt.slo_verdicts(mt.slo_report(src("oplog_v"), within_ms=100.0), "view", "click")


@query("label_stats", "E8", """SELECT count(*) AS images, CAST(sum(truth) AS BIGINT) AS total, round(avg(truth), 6) AS mean, median(truth) AS median, min(truth) AS min, max(truth) AS max,
round(stddev_pop(truth), 6) AS std FROM counts_v WHERE image_id % 7 <> 0""")
def label_stats(src):
    """A seventh of the images have no label."""
    labels = src("counts_v").withColumn("truth", F.expr("CASE WHEN image_id % 7 = 0 THEN NULL ELSE truth END"))
    return rounded(mt.label_stats(labels, "truth"), "mean", "std")


@query("label_histogram", "E8", "SELECT truth AS value, count(*) AS n FROM counts_v GROUP BY truth")
def label_histogram(src):
    return mt.histogram(src("counts_v"), "truth")


_PER_IMAGE = """SELECT o_orderkey AS image_id, coalesce(n, 0) AS n, round(coalesce(c, 0), 6) AS mean_confidence FROM orders LEFT JOIN
(SELECT image_id, count(*) AS n, avg(confidence) AS c FROM detections_v WHERE confidence >= 0.25 GROUP BY image_id) d ON image_id = o_orderkey"""


@query("detection_summary", "G12", _PER_IMAGE)
def detection_summary(src):
    images = src("orders").selectExpr("o_orderkey AS image_id")
    return rounded(mt.detection_summary(images, src("detections_v")), "mean_confidence")


_IMAGE_LINES = """SELECT o_orderkey AS image_id, count(det_id) AS n, coalesce(avg(confidence), 0) AS c FROM orders LEFT JOIN detections_v ON image_id = o_orderkey AND confidence >= 0.25 GROUP BY o_orderkey"""


@query("detection_stats", "E9", f"""SELECT count(*) AS images, count(*) FILTER (n > 0) AS with_detections, CAST(sum(n) AS BIGINT) AS detections, round(avg(n), 6) AS per_image,
min(n) AS min_lines, max(n) AS max_lines, round(avg(c), 6) AS mean_confidence FROM ({_IMAGE_LINES}) q""")
def detection_stats(src):
    images = src("orders").selectExpr("o_orderkey AS image_id")
    return rounded(mt.detection_stats(images, src("detections_v")), "per_image", "mean_confidence")


@query("detection_histogram", "E9", f"SELECT n AS value, count(*) AS n FROM ({_IMAGE_LINES}) q GROUP BY q.n")
def detection_histogram(src):
    return mt.detection_histogram(src("orders").selectExpr("o_orderkey AS image_id"), src("detections_v"))


@query("line_count_accuracy", "E10", """SELECT count(*) AS images, count(*) FILTER (truth = predicted) AS exact, round(avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END), 6) AS exact_accuracy,
round(avg(CASE WHEN abs(predicted - truth) <= 1 THEN 1 ELSE 0 END), 6) AS off_by_one_accuracy, round(avg(abs(predicted - truth)), 6) AS mae,
round(sqrt(avg((predicted - truth) * (predicted - truth))), 6) AS rmse FROM counts_v""")
def line_count_accuracy(src):
    return rounded(mt.line_count_accuracy(src("counts_v")), "exact_accuracy", "off_by_one_accuracy", "mae", "rmse")


@query("line_count_errors", "E10", "SELECT predicted - truth AS error, count(*) AS n FROM counts_v GROUP BY 1")
def line_count_errors(src):
    return mt.error_histogram(src("counts_v"))


@query("accuracy_by_truth", "E10", "SELECT truth, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END), 6) AS accuracy FROM counts_v GROUP BY truth")
def accuracy_by_truth(src):
    return rounded(mt.accuracy_by_truth(src("counts_v")), "accuracy")


@query("worst_counts", "E10", "SELECT image_id, truth, predicted FROM counts_v ORDER BY abs(predicted - truth) DESC, image_id LIMIT 5")
def worst_counts(src):
    return mt.worst_counts(src("counts_v")).select("image_id", "truth", "predicted")


@query("count_confusion", "E11", """WITH labels_seen AS (SELECT truth AS label FROM counts_v UNION SELECT predicted FROM counts_v)
SELECT t.label AS truth, p.label AS predicted, count(c.image_id) AS n FROM labels_seen t CROSS JOIN labels_seen p LEFT JOIN counts_v c ON c.truth = t.label AND c.predicted = p.label GROUP BY 1, 2""")
def count_confusion(src):
    return mt.confusion_matrix(src("counts_v"))


_PREDICTED = """SELECT image_id, truth, list_position(logits, list_max(logits)) - 1 AS predicted FROM logits_v"""


def _predicted(src):
    best = F.array_position("logits", F.array_max("logits")) - 1
    return src("logits_v").select("image_id", F.col("truth").cast("long").alias("truth"), best.alias("predicted"))


@query("script_confusion", "E11", f"""SELECT t.label AS truth, p.label AS predicted, count(c.image_id) AS n FROM (SELECT unnest(range(6)) AS label) t CROSS JOIN (SELECT unnest(range(6)) AS label) p
LEFT JOIN ({_PREDICTED}) c ON c.truth = t.label AND c.predicted = p.label GROUP BY 1, 2""")
def script_confusion(src):
    return mt.confusion_matrix(_predicted(src), labels=range(6)).select(
        F.col("truth").cast("long").alias("truth"), F.col("predicted").cast("long").alias("predicted"), "n"
    )


_CLASSES = f"""SELECT label, support, hits, CASE WHEN guessed > 0 THEN hits / CAST(guessed AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall,
CASE WHEN support + guessed > 0 THEN 2 * hits / CAST(support + guessed AS DOUBLE) ELSE 0 END AS f1 FROM (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (predicted = label) AS guessed,
count(*) FILTER (truth = label AND predicted = label) AS hits FROM ({_PREDICTED}) p, (SELECT unnest(range(5)) AS label) l GROUP BY label) q WHERE support + guessed > 0"""


@query("class_report", "E12", f"SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_CLASSES}) c")
def class_report(src):
    return rounded(mt.class_report(_predicted(src)), "precision", "recall", "f1").drop("hits")


@query("multiclass_metrics", "E12", f"""SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM ({_CLASSES}) c""")
def multiclass_metrics(src):
    return rounded(mt.multiclass_metrics(_predicted(src)), "accuracy", "precision", "recall", "f1")


_LONG = """SELECT 'top' AS side, t_top AS truth, p_top AS p FROM sides_v UNION ALL SELECT 'bottom', t_bottom, p_bottom FROM sides_v
UNION ALL SELECT 'left', t_left, p_left FROM sides_v UNION ALL SELECT 'right', t_right, p_right FROM sides_v"""
_CELLS = """count(*) FILTER (g AND truth) AS tp, count(*) FILTER (NOT g AND NOT truth) AS tn, count(*) FILTER (g AND NOT truth) AS fp, count(*) FILTER (NOT g AND truth) AS fn"""
_RATES = """round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), {empty}), 6) AS precision,
round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), {empty}), 6) AS recall, round(coalesce(CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, {empty}), 6) AS f1"""
THRESHOLDS = {"top": 0.5, "bottom": 0.6, "left": 0.4, "right": 0.55}


@query("side_metrics", "E13", f"""SELECT side, tp, tn, fp, fn, {_RATES.format(empty='0')} FROM (SELECT side, {_CELLS} FROM (
SELECT *, p >= CASE side WHEN 'top' THEN 0.5 WHEN 'bottom' THEN 0.6 WHEN 'left' THEN 0.4 ELSE 0.55 END AS g FROM ({_LONG}) l) q GROUP BY side) r""")
def side_metrics(src):
    return rounded(mt.side_metrics(src("sides_v"), THRESHOLDS), "accuracy", "precision", "recall", "f1")


@query("multilabel_summary", "E13", """SELECT round(avg(CASE WHEN a AND b AND c AND d THEN 1 ELSE 0 END), 6) AS exact_match,
round(avg((CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT)) / CAST(4 AS DOUBLE)), 6) AS micro_accuracy, round(avg(CASE WHEN t_top = (p_top > 0.7) THEN 1 ELSE 0 END), 6) AS piece_accuracy FROM (
SELECT *, (p_top >= 0.5) = t_top AS a, (p_bottom >= 0.6) = t_bottom AS b, (p_left >= 0.4) = t_left AS c, (p_right >= 0.55) = t_right AS d FROM sides_v) q""")
def multilabel_summary(src):
    done = mt.multilabel_summary(src("sides_v"), THRESHOLDS, piece=(F.col("t_top"), F.col("p_top") > 0.7))
    return rounded(done, "exact_match", "micro_accuracy", "piece_accuracy")


_JUDGE = """SELECT a.path, CASE WHEN a.id % 31 = 0 THEN 'segmentation' WHEN a.id % 17 = 0 THEN 'prediction' ELSE 'ok' END AS status, CASE WHEN a.id % 2 = 0 THEN 'bbox_runs' ELSE 'hull_segments' END AS method, a.has_top_edge AS t_top, a.has_bottom_edge AS t_bottom, a.has_left_edge AS t_left, a.has_right_edge AS t_right,
coalesce(f.has_top_edge, false) AS p_top, coalesce(f.has_bottom_edge, false) AS p_bottom, coalesce(f.has_left_edge, false) AS p_left, coalesce(f.has_right_edge, false) AS p_right
FROM {annotations_v} a JOIN {fragments_v} f ON f.id = a.id WHERE a.reviewed AND NOT a.skipped"""
_JUDGE_SQL = _JUDGE.replace("{", "").replace("}", "")
_JUDGED = f"""SELECT *, CAST(t_top IS NOT NULL AS INT) + CAST(t_bottom IS NOT NULL AS INT) + CAST(t_left IS NOT NULL AS INT) + CAST(t_right IS NOT NULL AS INT) AS known,
coalesce(CAST(t_top <> p_top AS INT), 0) + coalesce(CAST(t_bottom <> p_bottom AS INT), 0) + coalesce(CAST(t_left <> p_left AS INT), 0) + coalesce(CAST(t_right <> p_right AS INT), 0) AS errors FROM ({_JUDGE_SQL}) j"""


def _judge(src):
    return src.spark.sql(_JUDGE, annotations_v=src("annotations_v"), fragments_v=src("fragments_v"))


@query("annotation_side_metrics", "E14", f"""SELECT method, side, tp + tn + fp + fn AS labelled, tp, tn, fp, fn, {_RATES.format(empty='NULL')} FROM (SELECT method, side, {_CELLS} FROM (
SELECT method, status, 'top' AS side, t_top AS truth, p_top AS g FROM ({_JUDGE_SQL}) a UNION ALL SELECT method, status, 'bottom', t_bottom, p_bottom FROM ({_JUDGE_SQL}) b
UNION ALL SELECT method, status, 'left', t_left, p_left FROM ({_JUDGE_SQL}) c UNION ALL SELECT method, status, 'right', t_right, p_right FROM ({_JUDGE_SQL}) d) q WHERE status = 'ok' AND truth IS NOT NULL GROUP BY method, side) r""")
def annotation_side_metrics(src):
    return rounded(mt.annotation_side_metrics(_judge(src)), "accuracy", "precision", "recall", "f1")


@query("annotation_summary", "E14", f"""SELECT method, count(*) AS samples, count(*) FILTER (status = 'ok') AS evaluated, count(*) FILTER (status = 'segmentation') AS segmentation_failures,
count(*) FILTER (status = 'prediction') AS prediction_failures, count(*) FILTER (status = 'ok' AND known > 0) AS rated, count(*) FILTER (status = 'ok' AND known > 0 AND errors = 0) AS exact,
round(count(*) FILTER (status = 'ok' AND known > 0 AND errors = 0) / CAST(nullif(count(*) FILTER (status = 'ok' AND known > 0), 0) AS DOUBLE), 6) AS exact_accuracy FROM ({_JUDGED}) x GROUP BY method""")
def annotation_summary(src):
    return rounded(mt.annotation_summary(_judge(src)), "exact_accuracy")


@query("worst_annotations", "E14", f"SELECT path, errors FROM ({_JUDGED}) x WHERE status = 'ok' AND errors > 0 ORDER BY errors DESC, path LIMIT 12")
def worst_annotations(src):
    return mt.worst_annotations(_judge(src)).select("path", "errors")


def _tuning(grid: str) -> str:
    """The first threshold of a grid, in its order, with the best F1 of each side."""
    return f"""SELECT side, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY f1 DESC, turn) AS rn FROM (
SELECT side, threshold, turn, CASE WHEN tp > 0 THEN 2 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) ELSE 0 END AS f1 FROM (SELECT side, threshold, turn, {_CELLS} FROM (
SELECT l.side, l.truth, t.threshold, t.turn, l.p >= t.threshold AS g FROM ({_LONG}) l, (SELECT unnest([{grid}]) AS threshold, generate_subscripts([{grid}], 1) AS turn) t) q GROUP BY side, threshold, turn) r) s) u WHERE rn = 1"""


@query("tune_thresholds", "E15", _tuning("0.2e0, 0.25e0, 0.3e0, 0.35e0, 0.4e0, 0.45e0, 0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0"))
def tune_thresholds(src):
    return rounded(mt.tune_thresholds(src("sides_v")), "f1")


@query("tune_falling_thresholds", "E15", _tuning("0.99e0, 0.98e0, 0.6e0, 0.02e0, 0.2e0, 0.01e0"))
def tune_falling_thresholds(src):
    """A grid out of order with thresholds that tie: the first in the given order wins."""
    return rounded(mt.tune_thresholds(src("sides_v"), [0.99, 0.98, 0.6, 0.02, 0.2, 0.01]), "f1")


@query("aggregate_seeds", "E16", """SELECT event_type AS method, 'exact' AS metric, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (
SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY event_type, user_id) q GROUP BY event_type""")
def aggregate_seeds(src):
    per_seed = src("events").groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("seed")).agg(F.avg("value").alias("value"))
    return rounded(mt.aggregate_seeds(per_seed.withColumn("metric", F.lit("exact"))), "mean", "std")


_SPLIT = "CASE WHEN {id} % 20 < 14 THEN 'train' WHEN {id} % 20 < 17 THEN 'val' ELSE 'test' END"


@query("split_summary", "E17", f"""SELECT split, count(*) AS count, count(DISTINCT collection) AS collections, count(*) FILTER (has_top_edge) AS top, count(*) FILTER (has_bottom_edge) AS bottom,
count(*) FILTER (has_left_edge) AS left, count(*) FILTER (has_right_edge) AS right, count(*) FILTER (p = 'interior') AS interior, count(*) FILTER (p = 'edge') AS edge, count(*) FILTER (p = 'corner') AS corner FROM (
SELECT *, {_SPLIT.format(id='id')} AS split, CASE WHEN (coalesce(has_top_edge, false) OR coalesce(has_bottom_edge, false)) AND (coalesce(has_left_edge, false) OR coalesce(has_right_edge, false)) THEN 'corner'
WHEN coalesce(has_top_edge, false) OR coalesce(has_bottom_edge, false) OR coalesce(has_left_edge, false) OR coalesce(has_right_edge, false) THEN 'edge' ELSE 'interior' END AS p FROM annotations_v) q GROUP BY split""")
def split_summary(src):
    from ..functions.rules import piece_type

    samples = src("annotations_v").withColumn("split", F.expr(_SPLIT.format(id="id"))).withColumn(
        "piece_type", piece_type(*[F.col(s) for s in rel.SIDES])
    )
    return mt.split_summary(samples)


@query("class_weights", "E18", """SELECT label, n, round((SELECT count(*) FROM logits_v) / CAST(6 * greatest(n, 1) AS DOUBLE), 6) AS weight, round(1 / CAST(greatest(n, 1) AS DOUBLE), 6) AS sample_weight FROM (
SELECT label, count(image_id) AS n FROM (SELECT unnest(range(6)) AS label) c LEFT JOIN logits_v ON truth = label GROUP BY label) q""")
def class_weights(src):
    return rounded(mt.class_weights(src("logits_v"), "truth", range(6)), "weight", "sample_weight").withColumn("label", F.col("label").cast("long"))


@query("pos_weights", "E18", f"""SELECT side, positives, negatives, round(CASE WHEN positives > 0 THEN negatives / CAST(positives AS DOUBLE) ELSE 1 END, 6) AS pos_weight FROM (
SELECT side, count(*) FILTER (truth) AS positives, count(*) FILTER (NOT truth) AS negatives FROM ({_LONG}) l GROUP BY side) q""")
def pos_weights(src):
    return rounded(mt.pos_weights(src("sides_v")), "pos_weight")


@query("review_stats", "E19", """SELECT count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT reviewed) AS remaining FROM annotations_v""")
def review_stats(src):
    return mt.review_stats(src("annotations_v"))


@query("reviewed_by_collection", "E19", "SELECT collection, count(*) FILTER (reviewed) AS reviewed FROM annotations_v GROUP BY collection")
def reviewed_by_collection(src):
    return mt.reviewed_by_collection(src("annotations_v"))


_LABELS = """SELECT label, count(*) FILTER (hit) AS n FROM (SELECT 'top' AS label, has_top_edge AS hit FROM {0} UNION ALL SELECT 'bottom', has_bottom_edge FROM {0} UNION ALL SELECT 'left', has_left_edge FROM {0}
UNION ALL SELECT 'right', has_right_edge FROM {0} UNION ALL SELECT 'corner', coalesce(CAST(has_top_edge AS INT), 0) + coalesce(CAST(has_bottom_edge AS INT), 0) + coalesce(CAST(has_left_edge AS INT), 0) + coalesce(CAST(has_right_edge AS INT), 0) >= 2 FROM {0}) q GROUP BY label"""
TARGETS_SQL = f"""SELECT r.label, r.n AS reviewed_positives, p.n AS predicted_positives FROM ({_LABELS.format('(SELECT * FROM annotations_v WHERE reviewed AND NOT skipped) a')}) r
JOIN ({_LABELS.format('(SELECT * FROM fragments_v WHERE id % 4 <> 3) f')}) p ON p.label = r.label"""


def target_rows(src):
    """A quarter of the predicted fragments are not among the images at hand."""
    predictions = src("fragments_v").withColumnRenamed("image_path", "path")
    return mt.target_summary(src("annotations_v"), predictions, predictions.filter("id % 4 <> 3").select("path"))


@query("target_summary", "E19 E20", TARGETS_SQL)
def target_summary(src):
    return target_rows(src)


@query("auto_targets", "E20", f"SELECT label FROM ({TARGETS_SQL}) t WHERE predicted_positives > 0 ORDER BY reviewed_positives, predicted_positives DESC, label LIMIT 3")
def autotarget_rows(src):
    return mt.auto_targets(target_rows(src)).select("label")


@query("best_checkpoint", "E21", """WITH fresh AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new FROM history_v),
lasting AS (SELECT *, max(CASE WHEN is_new THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last_best FROM fresh),
stops AS (SELECT *, min(CASE WHEN epoch - last_best >= 15 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM lasting)
SELECT run, max(CASE WHEN is_new THEN epoch END) AS best_epoch, max(score) AS best_score, max(stop_epoch) AS stop_epoch, count(*) FILTER (is_new) AS improvements
FROM stops WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run""")
def best_checkpoint(src):
    return mt.best_checkpoint(src("history_v"), patience=15)


@query("layout_bounds", "E22", """SELECT project_id, min(x) AS min_x, min(y) AS min_y, round(max(x + width * scale_x), 6) AS max_x, round(max(y + height * scale_y), 6) AS max_y,
round((min(x) + max(x + width * scale_x)) / 2, 6) AS centre_x, round((min(y) + max(y + height * scale_y)) / 2, 6) AS centre_y FROM project_fragments_v GROUP BY project_id""")
def layout_bounds(src):
    return rounded(mt.layout_bounds(src("project_fragments_v")), "max_x", "max_y", "centre_x", "centre_y")


@query("clip_classes", "E23", """SELECT image_id, label FROM (SELECT image_id, label, count(*) OVER (PARTITION BY label) AS n FROM (SELECT image_id, least(greatest(truth, 0), 9) AS label FROM counts_v) q) r WHERE n >= 2""")
def clip_classes(src):
    counts = src("counts_v").withColumn("label", F.col("truth"))
    return mt.clip_and_filter_classes(counts, "label", 9).select("image_id", "label")
