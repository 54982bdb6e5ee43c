"""Ruler jobs over the profile and token views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ruler as ru
from .registry import query


@query("unit_from_text", "J1", """SELECT d.doc_id AS image_id, coalesce(unit, 'cm') AS unit, coalesce(x_max + 10, CAST(floor(len(profile) * 0.1e0) AS BIGINT)) AS text_end FROM documents d JOIN profiles_v p ON p.image_id = d.doc_id LEFT JOIN (
SELECT image_id, x_max, CASE WHEN contains(lower(text), 'mm') THEN 'mm' ELSE 'cm' END AS unit, row_number() OVER (PARTITION BY image_id ORDER BY token_no) AS rn FROM tokens_v WHERE contains(lower(text), 'mm') OR contains(lower(text), 'cm')) t ON t.image_id = d.doc_id AND rn = 1""")
def unit_from_text(src):
    images = src("profiles_v").select("image_id", F.size("profile").alias("width"))
    return ru.unit_from_text(images, src("tokens_v")).withColumn("text_end", F.col("text_end").cast("long"))


def _profiles(src):
    return src("profiles_v").withColumn("image_height", (F.col("image_id") % 4000).cast("double")).withColumn("text_end", F.lit(3))


def _ticks(df, name):
    return df.select("image_id", F.posexplode(name).alias("tick_no", "place"))


@query("ticks_fixed", "J2")
def ticks_fixed(src):
    return _ticks(_profiles(src).withColumn("t", ru.ticks_fixed(F.col("profile"), F.col("text_end"))), "t")


@query("ticks_adaptive", "J3")
def ticks_adaptive(src):
    return _ticks(_profiles(src).withColumn("t", ru.ticks_adaptive(F.col("profile"), F.col("image_height"), F.col("text_end"))), "t")


# two tick lists per profile: the places of long words
_LISTS = """SELECT image_id, n, list_filter(range(n), lambda i: profile[i + 1] >= 100) AS f, list_filter(range(n), lambda i: profile[i + 1] >= 120) AS a FROM (SELECT image_id, profile, len(profile) AS n FROM profiles_v) p"""
_SCORE = """CASE WHEN len({0}) < 2 THEN 0 WHEN list_min(list_transform(range(1, len({0})), lambda i: {0}[i + 1] - {0}[i])) < greatest(12, floor(n * 0.008e0)) THEN greatest(0, len({0}) - 5)
WHEN len({0}) BETWEEN 3 AND 15 THEN len({0}) + 10 WHEN len({0}) = 2 THEN 7 ELSE len({0}) END"""
_PICKED = f"SELECT image_id, CASE WHEN {_SCORE.format('f')} >= {_SCORE.format('a')} THEN f ELSE a END AS t FROM ({_LISTS}) l"
_GAP = "CASE WHEN len(t) >= 2 THEN list_median(list_transform(range(1, len(t)), lambda i: CAST(t[i + 1] - t[i] AS DOUBLE))) END"


def _lists(src):
    places = lambda limit: F.filter(
        F.transform("profile", lambda v, i: F.when(v >= limit, i)), lambda i: i.isNotNull()
    )
    return src("profiles_v").select("image_id", F.size("profile").alias("n"), places(100.0).alias("f"), places(120.0).alias("a"))


@query("pick_ticks", "J4", f"SELECT image_id, len(t) AS ticks, list_sum(t) AS total FROM ({_PICKED}) p")
def pick_ticks(src):
    picked = _lists(src).withColumn("t", ru.pick_ticks(F.col("f"), F.col("a"), F.col("n")))
    total = F.aggregate("t", F.lit(0).cast("long"), lambda s, v: s + v)
    return picked.select("image_id", F.size("t").cast("long").alias("ticks"), F.when(F.size("t") > 0, total).alias("total"))


@query("pixels_per_unit", "J5", f"SELECT image_id, {_GAP} AS ratio FROM ({_PICKED}) p")
def pixels_per_unit(src):
    picked = _lists(src).withColumn("t", ru.pick_ticks(F.col("f"), F.col("a"), F.col("n")))
    return picked.select("image_id", ru.pixels_per_unit(F.col("t")).alias("ratio"))


@query("scale_record", "J6", f"""SELECT image_id, CASE WHEN len(t) >= 2 THEN 'mm' END AS scale_unit, {_GAP} AS pixels_per_unit,
CASE WHEN len(t) >= 2 THEN 'success' ELSE 'error: Not enough ticks detected (' || len(t) || ')' END AS scale_detection_status, '3.1' AS scale_model_version FROM ({_PICKED}) p""")
def scale_record(src):
    picked = _lists(src).withColumn("t", ru.pick_ticks(F.col("f"), F.col("a"), F.col("n")))
    return picked.select("image_id", ru.scale_record(F.col("t"), F.lit("mm"), "3.1").alias("r")).select("image_id", "r.*")


@query("detect_scale", "J1 J2 J3 J4 J5 J6")
def detect_scale(src):
    return ru.detect_scale(_profiles(src).drop("text_end"), src("tokens_v"), "3.1")
