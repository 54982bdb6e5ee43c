"""Sources, sinks and the stream, fed from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import ranking as rk
from ..session import shared_folder
from ..sources import readers as rd
from ..sources import writers as wr
from ..streaming.ingest import ingest_stream, pending
from .registry import query


def _folder(src) -> str:
    """A fresh folder on the shared storage of the session."""
    return f"{shared_folder(src.spark)}/{uuid.uuid4().hex}"


@query("ingest_images", "A2", """SELECT fragment_id, min(image_path) AS image_path, 'pending' AS processing_status FROM (
SELECT regexp_replace(split_part(p, '/', 2), '\\.(jpg|JPEG|png)$', '') AS fragment_id, p AS image_path FROM (SELECT l_returnflag || CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) ||
CASE WHEN l_suppkey % 4 = 0 THEN '.jpg' WHEN l_suppkey % 4 = 1 THEN '.JPEG' WHEN l_suppkey % 4 = 2 THEN '.png' ELSE '.txt' END AS p FROM lineitem WHERE l_suppkey % 4 <> 3) q) r
WHERE CAST(fragment_id AS BIGINT) NOT IN (SELECT id FROM fragments_v WHERE processing_status = 'failed') GROUP BY fragment_id""")
def ingest_images(src):
    listing = src("lineitem").selectExpr(
        """l_returnflag || l_linenumber || CASE WHEN l_tax > 0.04 THEN '\\\\' ELSE '/' END || l_partkey ||
        CASE WHEN l_suppkey % 4 = 0 THEN '.jpg' WHEN l_suppkey % 4 = 1 THEN '.JPEG' WHEN l_suppkey % 4 = 2 THEN '.png' ELSE '.txt' END AS path"""
    )
    existing = src("fragments_v").filter("processing_status = 'failed'").select(F.col("id").cast("string").alias("fragment_id"))
    return rd.new_fragments(listing, existing)


@query("load_annotations", "A3", """SELECT replace(path, chr(92), '/') AS path, has_top_edge, CASE WHEN id % 3 = 0 THEN NULL ELSE has_left_edge END AS has_left_edge, reviewed, false AS skipped,
CASE WHEN id % 2 = 0 THEN 'seen' ELSE '' END AS notes FROM annotations_v""")
def load_annotations(src):
    stores = src("annotations_v").selectExpr(
        """'{"version": 1, "annotations": {"' || replace(path, '\\\\', '\\\\\\\\') || '": {"has_top_edge": ' || coalesce(CAST(has_top_edge AS STRING), 'null') ||
        ', "has_left_edge": ' || CASE WHEN id % 3 = 0 THEN '"yes"' ELSE coalesce(CAST(has_left_edge AS STRING), 'null') END ||
        ', "reviewed": ' || CASE WHEN id % 6 = 1 THEN CAST(int(reviewed) AS STRING) ELSE CAST(reviewed AS STRING) END ||
        CASE WHEN id % 2 = 0 THEN ', "notes": "seen"' ELSE '' END || '}}}' AS value"""
    )
    return rd.parse_annotations(stores).select("path", "has_top_edge", "has_left_edge", "reviewed", "skipped", "notes")


@query("label_files", "A4", """SELECT 'csv' AS kind, CAST(image_id AS VARCHAR) || '.jpg' AS name, truth AS n FROM counts_v UNION ALL SELECT 'txt', CAST(p_size AS VARCHAR), count(*) FILTER (p_partkey % 5 <> 0) FROM part GROUP BY p_size""")
def label_files(src):
    folder = _folder(src)
    src("counts_v").select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("File Name"), F.col("truth").alias("Line Count")).write.option("header", True).csv(f"{folder}/csv")
    src("part").selectExpr("p_size", "CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE '0 0.5 0.5 0.1 0.1' END AS value").write.partitionBy("p_size").text(f"{folder}/txt")
    csv = rd.load_label_csv(src.spark, f"{folder}/csv", "Line Count", "bigint")
    # the writer names files itself, so the image is the folder of the label file
    lines = src.spark.read.text(f"{folder}/txt").groupBy(F.col("p_size").cast("string").alias("name")).agg(F.count_if(F.trim("value") != "").alias("n"))
    return csv.select(F.lit("csv").alias("kind"), F.col("file_name").alias("name"), F.col("label").alias("n")).union(lines.select(F.lit("txt"), "name", "n"))


@query("write_matches", "A5", """SELECT match_id, algorithm_version, CASE WHEN algorithm_version = '2.0' THEN 0 ELSE score END AS score FROM matches_v WHERE algorithm_version <> '2.0' OR rank = 1""")
def write_matches(src):
    """All versions written, then version 2.0 replaced by its first ranks."""
    path = _folder(src)
    matches = src("matches_v").select("match_id", "score", "rank", "algorithm_version")
    wr.write_matches(matches, path)
    wr.write_matches(matches.filter("algorithm_version = '2.0' AND rank = 1").withColumn("score", F.lit(0.0)), path)
    stored = src.spark.read.schema("match_id string, score double, rank int, algorithm_version string").parquet(path)
    return stored.select("match_id", "algorithm_version", "score")


@query("export_annotations", "A6 B22", """SELECT image_path AS relative_path, f.collection, CAST(f.id AS VARCHAR) || '.jpg' AS filename, a.has_top_edge, CASE WHEN coalesce(a.has_top_edge, false) OR coalesce(a.has_bottom_edge, false) OR coalesce(a.has_left_edge, false) OR coalesce(a.has_right_edge, false) THEN true
WHEN a.id IS NULL OR a.has_top_edge IS NULL OR a.has_bottom_edge IS NULL OR a.has_left_edge IS NULL OR a.has_right_edge IS NULL THEN NULL ELSE false END AS edge_piece, coalesce(a.reviewed, false) AS reviewed, 'a "b", c' AS notes
FROM fragments_v f LEFT JOIN annotations_v a ON a.path = f.image_path""")
def export_annotations(src):
    notes = src("annotations_v").withColumn("notes", F.lit('a "b", c'))
    images = src("fragments_v").select(F.col("image_path").alias("path"))
    path = _folder(src)
    wr.export_csv(wr.annotation_export(images, notes).withColumn("notes", F.lit('a "b", c')), path)
    back = src.spark.read.option("header", True).option("escape", '"').csv(path)
    flag = lambda c: F.col(c).try_cast("boolean").alias(c)
    return back.select("relative_path", "collection", "filename", flag("has_top_edge"), flag("edge_piece"), flag("reviewed"), "notes")


@query("write_manifests", "A7 F1", """SELECT image_id, CASE WHEN place <= floor(n * 0.7e0 + 0.5e0) THEN 'train' WHEN place <= floor(n * (0.7e0 + 0.15e0) + 0.5e0) THEN 'val' ELSE 'test' END AS split FROM (
SELECT image_id, row_number() OVER (PARTITION BY truth ORDER BY md5('42|' || image_id), image_id) AS place, count(*) OVER (PARTITION BY truth) AS n FROM counts_v) q""")
def write_manifests(src):
    path = _folder(src)
    wr.write_manifests(rk.stratified_split(src("counts_v"), "truth", "image_id").select("image_id", "truth", "split"), path)
    return src.spark.read.schema("image_id long, truth long, split string").json(path).select("image_id", "split")


@query("scan_log_errors", "A8", """SELECT count(*) AS error_lines, (SELECT string_agg(l, '|' ORDER BY event_id) FROM (SELECT event_id, trim(l) AS l FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN ' ERROR ' ELSE 'INFO ' END || user_id || CASE WHEN event_id % 500 = 7 THEN ' CRITICAL' ELSE '' END AS l FROM events) a
WHERE contains(l, 'ERROR') OR contains(l, 'CRITICAL') ORDER BY event_id LIMIT 10) b) AS sample FROM events WHERE event_type = 'error' OR event_id % 500 = 7""")
def scan_log_errors(src):
    lines = src("events").selectExpr(
        "event_id AS line_no",
        "CASE WHEN event_type = 'error' THEN ' ERROR ' ELSE 'INFO ' END || user_id || CASE WHEN event_id % 500 = 7 THEN ' CRITICAL' ELSE '' END AS value",
    )
    return rd.scan_log_errors(lines).withColumn("sample", F.array_join("sample", "|"))


@query("list_images", "A2", "SELECT n_name AS folder, n_nationkey AS n FROM nation")
def list_images(src):
    """Files under a root whose name reads as a pattern, listed by their place under it."""
    root = f"{_folder(src)}/im(1)+x [a]"
    rows = src("nation").selectExpr("n_name", "n_nationkey", "explode(sequence(0, int(n_nationkey))) AS i").filter("i > 0 OR n_nationkey = 0")
    rows.select("n_name", "i", F.lit("x").alias("value")).repartition("n_name", "i").write.partitionBy("n_name", "i").text(root)
    listed = rd.list_images(src.spark, root).filter("path LIKE '%.txt'")
    place = F.split("path", "/")
    folder = F.regexp_replace(place[0], "^n_name=", "")
    counts = listed.groupBy(folder.alias("folder")).agg(F.count_if(place[1] != "i=0").alias("n"))
    return counts


@query("scan_log_files", "A8", """SELECT 2 * count(*) AS error_lines, 0 AS missing, (SELECT string_agg(l, '|' ORDER BY event_id) FROM (SELECT event_id, 'ERROR ' || event_id AS l FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10) a) AS sample FROM events WHERE event_type = 'error'""")
def scan_log_files(src):
    """Two logs, the second written first; a log that is not there counts nothing."""
    folder = _folder(src)
    lines = src("events").filter("event_type = 'error'").selectExpr("event_id", "'ERROR ' || event_id AS value")
    for name in ("b.log", "a.log"):
        lines.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select("value").write.text(f"{folder}/{name}")
    found = rd.scan_log_errors(rd.read_log(src.spark, f"{folder}/*.log"))
    missing = rd.scan_log_errors(rd.read_log(src.spark, f"{folder}/none.log")).select("error_lines").scalar()
    return found.select("error_lines", missing.alias("missing"), F.array_join("sample", "|").alias("sample"))


@query("no_matches_yet", "E5", "SELECT false AS has_matches, 0 AS n, count(*) AS fragments FROM part")
def no_matches_yet(src):
    """A table of matches that nobody has written."""
    stored = rd.read_or_empty(src.spark, f"{_folder(src)}/matches", "match_id string, score double")
    return mt.has_matches(stored).withColumn("fragments", src("part").agg(F.count(F.lit(1))).scalar())


@query("ingest_stream", "K1 G2", """SELECT 'F' || CAST(user_id AS VARCHAR) AS fragment_id, 'pending' AS processing_status FROM events GROUP BY user_id""")
def ingest_stream_query(src):
    folder = _folder(src)
    src("events").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{folder}/in")
    query_ = ingest_stream(
        src.spark, f"{folder}/in", "event_id long, ts timestamp, user_id long, event_type string, value double, props string, day date",
        lambda b: b.selectExpr("'F' || user_id AS fragment_id", "event_type || '/' || user_id || '.jpg' AS image_path"),
        f"{folder}/table", f"{folder}/checkpoint", files_per_batch=10,
    )
    query_.awaitTermination()
    return pending(src.spark, f"{folder}/table").select("fragment_id", "processing_status")


@query("ingest_to_score", "K1 G2", """SELECT fragment_id, CASE WHEN has_circle IS NULL THEN 'circle,' ELSE '' END || 'edges' || CASE WHEN script_type IS NULL OR version IS DISTINCT FROM 'v2' THEN ',script' ELSE '' END AS to_score FROM (
SELECT 'F' || CAST(o_orderkey AS VARCHAR) AS fragment_id, CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS script_type, CASE WHEN o_custkey % 5 < 2 THEN 'v2' WHEN o_custkey % 5 = 2 THEN 'v1' END AS version,
CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 4 = 0 END AS has_circle FROM orders) q""")
def ingest_to_score(src):
    """Catalogue rows that arrive in several files, with the scorers that each still needs."""
    folder = _folder(src)
    rows = src("orders").selectExpr(
        "'F' || o_orderkey AS fragment_id", "o_orderkey || '.jpg' AS image_path", "CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS script_type",
        "CASE WHEN o_custkey % 5 < 2 THEN 'v2' WHEN o_custkey % 5 = 2 THEN 'v1' END AS script_type_classification_model_version",
        "CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 4 = 0 END AS has_circle",
    )
    rows.repartition(6, "fragment_id").write.parquet(f"{folder}/in")
    query_ = ingest_stream(
        src.spark, f"{folder}/in", rows.schema, lambda b: b, f"{folder}/table", f"{folder}/checkpoint", files_per_batch=3,
        scorers={"script": "v2", "circle": "1", "edges": "1"},
    )
    query_.awaitTermination()
    return pending(src.spark, f"{folder}/table").select("fragment_id", F.array_join("to_score", ",").alias("to_score"))
