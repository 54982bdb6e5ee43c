"""Model outputs turned into catalogue fields."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.rules import piece_type
from ..operators import metrics as mt
from ..operators import model_outputs as mo
from ..operators.staged import Scorer, dry_run, staged_run
from .registry import query

CLASSES = [
    "Early South Turkestan Brahmi", "North Turkestan Brahmi", "North Turkestan Brahmi, type a",
    "South Turkestan Brahmi", "Turkestan Gupta Type",
]


@mo.register
class WordCountPredictor(mo.Predictor):
    """A stand-in scorer: lines and words of the whole text; refuses empty texts."""

    def predict(self, row):
        text = row["text"]
        if not text.strip():
            raise ValueError("no text")
        if row["doc_id"] % 17 == 3:
            raise ValueError("bad scan")
        return json.dumps({"lines": text.count("\n") + 1, "chars": len(text)})


@query("score_batches", "G1", """SELECT doc_id, CASE WHEN doc_id % 17 <> 3 THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS lines,
CASE WHEN doc_id % 17 <> 3 THEN length(text) END AS chars, CASE WHEN doc_id % 17 = 3 THEN 'bad scan' END AS error FROM documents""")
def score_batches(src):
    scored = mo.score_batches(src("documents").select("doc_id", "text"), "doc_id", mo.predictor("wordcount"))
    parsed = F.from_json("prediction", "lines long, chars long")
    return scored.select("doc_id", parsed["lines"].alias("lines"), parsed["chars"].alias("chars"), "error")


_VERSIONED = [
    "id", "script_type", "line_count", "scale_unit", "has_circle",
    "CASE WHEN has_segmentation THEN '{}' END AS segmentation_coords",
    *[f"model_version AS {k}_model_version" for k in ("line_detection", "script_type_classification", "segmentation", "classification", "scale")],
]
_NEW = "model_version IS DISTINCT FROM '2.0'"


@query("needs_processing", "G2", f"""SELECT id, {_NEW} AS line, script_type IS NULL OR {_NEW} AS script, NOT has_segmentation OR {_NEW} AS segmentation, line_count IS NULL OR {_NEW} AS count,
scale_unit IS NULL OR {_NEW} AS scale, has_circle IS NULL AS circle, true AS edges FROM fragments_v""")
def needs_processing(src):
    kinds = ("line", "script", "segmentation", "count", "scale", "circle", "edges")
    return src("fragments_v").selectExpr(*_VERSIONED).select("id", *[mo.needs_processing(k, "2.0").alias(k) for k in kinds])


@query("needs_processing_forced", "G2", f"""SELECT count(*) AS line, count(*) AS script, count(*) FILTER (NOT has_segmentation OR {_NEW}) AS segmentation, count(*) FILTER (line_count IS NULL OR {_NEW}) AS count,
count(*) AS scale, count(*) FILTER (has_circle IS NULL) AS circle, count(*) AS edges FROM fragments_v""")
def needs_processing_forced(src):
    kinds = ("line", "script", "segmentation", "count", "scale", "circle", "edges")
    return src("fragments_v").selectExpr(*_VERSIONED).agg(*[F.count_if(mo.needs_processing(k, "2.0", force=True)).alias(k) for k in kinds])


_RESULTS = """SELECT l_partkey AS id, lpad(CAST(l_orderkey AS VARCHAR(20)), 12, '0') || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS processor_no, l_returnflag <> 'R' AS success,
CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'line_count' WHEN l_suppkey % 3 = 1 THEN 'script_type' ELSE 'processing_error' END AS field,
CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linestatus || CAST(l_linenumber AS VARCHAR(20)) END AS value FROM {lineitem}"""


@query("merge_updates", "G3", f"""SELECT id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY processor_no DESC) AS rn FROM ({_RESULTS.replace('{', '').replace('}', '')}) r WHERE field IS NOT NULL) q WHERE rn = 1""")
def merge_updates(src):
    return mo.merge_updates(src.spark.sql(_RESULTS, lineitem=src("lineitem")))


@query("run_outcome", "G3", "SELECT l_partkey AS id, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) = 1 AS ok FROM lineitem GROUP BY l_partkey")
def run_outcome(src):
    return mo.run_outcome(src.spark.sql(_RESULTS, lineitem=src("lineitem")))


# a run of four scorers: lines from detections, then script and scale from the line count, then a flag from the script
_STAGED = """counted AS (SELECT image_id, count(*) FILTER (confidence >= 0.25e0) AS n, max(confidence) >= 0.5e0 AS fine FROM detections_v GROUP BY image_id),
one AS (SELECT f.id, f.script_type AS script_0, f.line_count AS lines_0, f.scale_unit AS unit_0, f.has_circle AS circle_0, c.image_id IS NOT NULL AND f.line_count IS NULL AS ran_1, coalesce(c.fine, false) AS fine,
CASE WHEN f.line_count IS NULL AND c.fine THEN c.n ELSE f.line_count END AS line_count FROM fragments_v f LEFT JOIN counted c ON c.image_id = f.id),
two AS (SELECT *, script_0 IS NULL OR coalesce(line_count, 0) > 2 AS ran_2, line_count IS NOT NULL AS fine_2, unit_0 IS NULL AS ran_3 FROM one),
three AS (SELECT *, CASE WHEN ran_2 AND fine_2 THEN 'lines ' || CAST(line_count AS VARCHAR) ELSE script_0 END AS script_type,
CASE WHEN ran_3 THEN CASE WHEN line_count > 1 THEN 'cm' END ELSE unit_0 END AS scale_unit FROM two),
four AS (SELECT *, coalesce(script_type LIKE 'lines %', false) AS ran_4 FROM three),
last AS (SELECT *, CASE WHEN ran_4 THEN line_count % 2 = 0 ELSE circle_0 END AS has_circle,
CASE WHEN ran_4 OR (ran_2 AND fine_2) THEN NULL WHEN ran_2 THEN 'no lines' WHEN ran_1 AND NOT fine THEN 'faint' END AS processing_error FROM four)"""


def _staged(src):
    detections = src("detections_v").groupBy("image_id").agg(
        F.count_if(F.col("confidence") >= 0.25).alias("n"), (F.max("confidence") >= 0.5).alias("success")
    )

    def lines(rows):
        met = rows.join(detections, rows["id"] == detections["image_id"])
        return met.select("id", "success", F.col("n").alias("line_count"), F.when(~F.col("success"), "faint").alias("processing_error")).withColumn(
            "wrote", F.when(F.col("success"), F.array(F.lit("line_count"))).otherwise(F.array(F.lit("processing_error")))
        )

    count = F.col("line_count")
    return src("fragments_v").select("id", "script_type", "line_count", "scale_unit", "has_circle"), [
        Scorer("lines", ("line_count",), ("line_count", "processing_error"), lines, count.isNull()),
        Scorer(
            "script", ("script_type", "line_count"), ("script_type", "processing_error"),
            {"script_type": F.concat(F.lit("lines "), count), "processing_error": F.when(count.isNull(), "no lines")},
            F.col("script_type").isNull() | (count > 2), count.isNotNull(), on_failure=("processing_error",),
        ),
        Scorer("scale", ("scale_unit", "line_count"), ("scale_unit",), {"scale_unit": F.when(count > 1, "cm")}, F.col("scale_unit").isNull()),
        Scorer(
            "circle", ("script_type", "line_count"), ("has_circle", "processing_error"),
            {"has_circle": count % 2 == 0, "processing_error": F.lit(None).cast("string")}, F.col("script_type").startswith("lines "),
        ),
    ]


@query("staged_run", "G3 G2", f"""WITH {_STAGED}
SELECT id, line_count, script_type, scale_unit, has_circle, processing_error, (ran_1 AND fine) OR (ran_2 AND fine_2) OR ran_3 OR ran_4 AS ok FROM last""")
def staged_run_query(src):
    return staged_run(*_staged(src)).select(
        "id", "line_count", "script_type", "scale_unit", "has_circle", "processing_error", F.col("outcome.ok").alias("ok")
    )


@query("dry_run", "G3 G2", f"""WITH {_STAGED}
SELECT id, (ran_1 AND fine) OR (ran_2 AND fine_2) OR ran_3 OR ran_4 AS ok, concat_ws(',', CASE WHEN ran_1 THEN 'lines' END, CASE WHEN ran_2 THEN 'script' END, CASE WHEN ran_3 THEN 'scale' END, CASE WHEN ran_4 THEN 'circle' END) AS ran,
concat_ws(',', CASE WHEN ran_1 AND NOT fine THEN 'lines' END, CASE WHEN ran_2 AND NOT fine_2 THEN 'script' END) AS failed,
concat_ws(',', CASE WHEN ran_4 THEN 'has_circle' END, CASE WHEN ran_1 AND fine THEN 'line_count' END, CASE WHEN (ran_1 AND NOT fine) OR ran_2 OR ran_4 THEN 'processing_error' END,
CASE WHEN ran_3 THEN 'scale_unit' END, CASE WHEN ran_2 AND fine_2 THEN 'script_type' END) AS updated,
concat_ws(',', CASE WHEN has_circle IS DISTINCT FROM circle_0 THEN 'has_circle' END, CASE WHEN line_count IS DISTINCT FROM lines_0 THEN 'line_count' END, CASE WHEN processing_error IS NOT NULL THEN 'processing_error' END,
CASE WHEN scale_unit IS DISTINCT FROM unit_0 THEN 'scale_unit' END, CASE WHEN script_type IS DISTINCT FROM script_0 THEN 'script_type' END) AS changed FROM last""")
def dry_run_query(src):
    return dry_run(*_staged(src)).select("id", "ok", *[F.array_join(c, ",").alias(c) for c in ("ran", "failed", "updated", "changed")])


@query("lines_from_detections", "G4", """SELECT det_id, image_id, row_number() OVER (PARTITION BY image_id ORDER BY y1, det_no, det_id) AS line_id, count(*) OVER (PARTITION BY image_id) AS num_lines
FROM detections_v WHERE confidence >= 0.25""")
def lines_from_detections(src):
    slim = src("detections_v").select("image_id", "det_no", "det_id", "y1", "confidence")
    return mo.lines_from_detections(slim).select("det_id", "image_id", "line_id", "num_lines")


@query("lines_record", "G4", """SELECT o_orderkey AS image_id, coalesce(n, 0) AS num_lines, coalesce(line_ids, '') AS line_ids, coalesce(tops, '') AS tops, round(coalesce(c, 0), 6) AS mean_confidence, '2.1' AS model_version FROM orders LEFT JOIN (
SELECT image_id, count(*) AS n, avg(confidence) AS c, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS line_ids, string_agg(CAST(CAST(y1 AS BIGINT) AS VARCHAR) || '/' || det_id, ',' ORDER BY place) AS tops FROM (
SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y1, det_no, det_id) AS place FROM detections_v WHERE confidence >= 0.25) d GROUP BY image_id) e ON image_id = o_orderkey""")
def lines_record(src):
    """The detection ids stand in for the x coordinates, to show which line is which."""
    detections = src("detections_v").withColumn("x1", F.col("det_id"))
    rows = mo.lines_record(src("orders").selectExpr("o_orderkey AS image_id"), detections, "2.1")
    return rows.select(
        "image_id", "num_lines", F.array_join(F.transform("lines", lambda x: x["line_id"].cast("string")), ",").alias("line_ids"),
        F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["bbox"]["y1"].cast("long").cast("string"), x["bbox"]["x1"])), ",").alias("tops"),
        F.round("mean_confidence", 6).alias("mean_confidence"), "model_version",
    )


@query("circle_flag", "G5", "SELECT o_orderkey AS image_id, o_orderkey IN (SELECT image_id FROM detections_v WHERE class_no = 0 AND confidence >= 0.6) AS has_circle FROM orders")
def circle_flag(src):
    return mo.circle_flag(src("orders").selectExpr("o_orderkey AS image_id"), src("detections_v"), 0.6)


@query("classify", "G6", f"""SELECT image_id, list_position(logits, list_max(logits)) - 1 AS class_index, ({CLASSES!r})[list_position(logits, list_max(logits))] AS class_name,
round(exp(list_max(logits)) / z, 6) AS confidence, round(exp(logits[3]) / z, 6) AS third, CASE WHEN exp(list_max(logits)) / z < 0.6 THEN 'completed_low_confidence' ELSE 'completed' END AS status
FROM (SELECT *, list_sum(list_transform(logits, lambda v: exp(v))) AS z FROM logits_v) q""")
def classify(src):
    done = mo.classify(src("logits_v"), CLASSES, 0.6)
    return done.select(
        "image_id", "class_index", "class_name", F.round("confidence", 6).alias("confidence"),
        F.round(F.col("probabilities")[CLASSES[2]], 6).alias("third"), "status",
    )


_BORDERS = {"top": 0.5, "bottom": 0.6, "left": 0.4, "right": 0.55}


@query("borders_from_probs", "G7 G8", """SELECT image_id, concat_ws(',', CASE WHEN t THEN 'top_edge' END, CASE WHEN b THEN 'bottom_edge' END, CASE WHEN l THEN 'left_edge' END, CASE WHEN r THEN 'right_edge' END) AS borders,
concat_ws(',', CASE WHEN NOT t THEN 'top_edge' END, CASE WHEN NOT b THEN 'bottom_edge' END, CASE WHEN NOT l THEN 'left_edge' END, CASE WHEN NOT r THEN 'right_edge' END) AS tears,
CASE WHEN (t OR b) AND (l OR r) THEN 'corner' WHEN t OR b OR l OR r THEN 'edge' ELSE 'interior' END AS piece_type,
CASE WHEN p_top >= p_bottom AND p_top >= p_left THEN 'interior' WHEN p_bottom >= p_left THEN 'edge' ELSE 'corner' END AS piece_guess
FROM (SELECT *, p_top >= 0.5 AS t, p_bottom >= 0.6 AS b, p_left >= 0.4 AS l, p_right >= 0.55 AS r FROM sides_v) q""")
def borders_from_probs(src):
    probs = F.array("p_top", "p_bottom", "p_left", "p_right")
    made = mo.borders_from_probs(probs, list(_BORDERS.values()), piece=F.array("p_top", "p_bottom", "p_left"))
    return src("sides_v").select("image_id", made.alias("m")).select(
        "image_id", F.concat_ws(",", "m.borders").alias("borders"), F.concat_ws(",", "m.tears").alias("tears"), "m.piece_type", "m.piece_guess"
    )


@query("piece_types", "G8", """SELECT piece_type, count(*) AS n, count(*) FILTER (piece_type <> 'interior') AS edge_pieces FROM (SELECT CASE WHEN (coalesce(has_top_edge, false) OR coalesce(has_bottom_edge, false)) AND (coalesce(has_left_edge, false) OR coalesce(has_right_edge, false)) THEN 'corner'
WHEN coalesce(has_top_edge, false) OR coalesce(has_bottom_edge, false) OR coalesce(has_left_edge, false) OR coalesce(has_right_edge, false) THEN 'edge' ELSE 'interior' END AS piece_type FROM fragments_v) q GROUP BY piece_type""")
def piece_types(src):
    kind = piece_type(*[F.col(f"has_{s}_edge") for s in mt.SIDE_NAMES])
    return src("fragments_v").groupBy(kind.alias("piece_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind != "interior").alias("edge_pieces")
    )


@query("crop_boxes", "G9", """SELECT image_id, greatest(0, CAST(trunc(x1) AS BIGINT) - 10) AS x1, greatest(0, CAST(trunc(y1) AS BIGINT) - 10) AS y1, least(100, CAST(trunc(x2) AS BIGINT) + 10) AS x2, least(400, CAST(trunc(y2) AS BIGINT) + 10) AS y2, class_no
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_no, det_id) AS rn FROM detections_v) q WHERE rn = 1""")
def crop_boxes(src):
    box = mo.crop_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(100), F.lit(400))
    made = mo.primary_detection(src("detections_v")).select("image_id", box.alias("b"), "class_no")
    return made.select("image_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "class_no")


@query("crop_geometry", "G10", """SELECT id, x0, y0, x1, y1, CASE WHEN big > 1024 THEN greatest(3, round_even(ow * (1024 / big), 0)) ELSE ow END AS out_width, CASE WHEN big > 1024 THEN greatest(3, round_even(oh * (1024 / big), 0)) ELSE oh END AS out_height FROM (
SELECT *, greatest(ow, oh) AS big FROM (SELECT *, CASE WHEN ppu > 0 THEN greatest(3, round_even((x1 - x0 + 1) * greatest(0.05e0, 120 / ppu), 0)) ELSE x1 - x0 + 1 END AS ow,
CASE WHEN ppu > 0 THEN greatest(3, round_even((y1 - y0 + 1) * greatest(0.05e0, 120 / ppu), 0)) ELSE y1 - y0 + 1 END AS oh FROM (
SELECT p.id, max(pixels_per_unit) AS ppu, greatest(0, CAST(min(x) AS BIGINT) - 4) AS x0, greatest(0, CAST(min(y) AS BIGINT) - 4) AS y0, least(1199, CAST(max(x) AS BIGINT) + 4) AS x1, least(999, CAST(max(y) AS BIGINT) + 4) AS y1
FROM points_v p JOIN fragments_v f ON f.id = p.id GROUP BY p.id) a) b) c""")
def crop_geometry(src):
    crop = mo.crop_geometry(F.col("xs"), F.col("ys"), F.lit(1200), F.lit(1000), F.col("pixels_per_unit"), target=120.0)
    made = src("contours_v").select("id", crop.alias("c"))
    # sizes are capped for fragments with a known ratio only
    return made.select("id", *[F.col(f"c.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "c.out_width", "c.out_height")


@query("train_classifier", "G11 E12")
def train_classifier(src):
    """Weighted multinomial model on the embeddings, evaluated on all of them."""
    data = src("embeddings").withColumn("features", F.col("embedding").cast("array<double>")).select("vec_id", "features", "label")
    model = mo.train_classifier(data, "features", "label", range(10))
    guessed = mo.predict_classes(model, data, "features").select(
        F.col("label").cast("long").alias("truth"), F.col("prediction").cast("long").alias("predicted")
    )
    return mt.multiclass_metrics(guessed)


@query("train_side_classifiers", "G11 E13 E15")
def train_side_classifiers(src):
    """One weighted binary model per side, thresholds tuned on its own scores."""
    sides = src("sides_v").select("image_id", *[f"t_{s}" for s in mt.SIDE_NAMES])
    data = src("embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("features")).join(sides, "image_id")
    models = mo.train_side_classifiers(data, "features", [f"t_{s}" for s in mt.SIDE_NAMES])
    return mt.tune_thresholds(mo.predict_sides(models, data, "features"))
