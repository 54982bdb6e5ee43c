"""Fragment-domain views over the supplied tables.

Every view is one SQL text with the input tables in braces.  Spark runs it with DataFrames in the
braces, the checks run it as a common table expression.  Where the two engines spell a generator
differently the text is built from a small dialect map; a view that Spark would compute value by value
is a function of its inputs there.  Nothing is sampled or cut short.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

HALF = "CAST(floor(p_partkey / 2.0) AS BIGINT)"
GROUP = f"(CASE WHEN {HALF} % 3 = 0 THEN 0 ELSE {HALF} % 50 END)"  # a third of the rows share one collection

_FRAGMENTS = f"""
SELECT p_partkey AS id,
  'OR' || CAST({HALF} AS VARCHAR(20)) || '_' || CAST({HALF} % 400 AS VARCHAR(20))
    || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END
    || CASE WHEN {HALF} % 3 = 1 THEN '' ELSE '_L [COL' || CAST({GROUP} AS VARCHAR(20)) || ']' END AS fragment_id,
  'COL' || CAST({GROUP} AS VARCHAR(20)) || '/' || CAST(p_partkey AS VARCHAR(20)) || '.jpg' AS image_path,
  'COL' || CAST({GROUP} AS VARCHAR(20)) AS collection,
  CASE WHEN p_partkey % 11 = 0 THEN NULL
    WHEN p_partkey % 97 = 5 THEN ''
    WHEN CAST(substr(p_brand, 7) AS BIGINT) % 5 = 0 THEN 'Early South Turkestan Brahmi'
    WHEN CAST(substr(p_brand, 7) AS BIGINT) % 5 = 1 THEN 'North Turkestan Brahmi'
    WHEN CAST(substr(p_brand, 7) AS BIGINT) % 5 = 2 THEN 'North Turkestan Brahmi, type a'
    WHEN CAST(substr(p_brand, 7) AS BIGINT) % 5 = 3 THEN 'South Turkestan Brahmi'
    ELSE 'Turkestan Gupta Type' END AS script_type,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 16 END AS line_count,
  CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS edge_piece,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 3 = 0 END AS has_top_edge,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS has_bottom_edge,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 7 < 3 END AS has_left_edge,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_partkey % 4 = 0 END AS has_right_edge,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 10 = 1 END AS has_circle,
  CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'mm' ELSE 'cm' END AS scale_unit,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice / CAST(10 AS DOUBLE) END AS pixels_per_unit,
  CASE WHEN p_partkey % 6 = 0 THEN 'error: no ticks' WHEN p_partkey % 31 = 1 THEN NULL ELSE 'success' END AS scale_detection_status,
  CASE WHEN p_partkey % 10 < 4 THEN 'completed' WHEN p_partkey % 10 < 6 THEN 'pending'
    WHEN p_partkey % 10 = 6 THEN 'failed' WHEN p_partkey % 10 = 7 THEN 'completed_low_confidence'
    ELSE NULL END AS processing_status,
  CASE WHEN p_partkey % 4 = 0 THEN '1.0' WHEN p_partkey % 4 = 1 THEN '2.0' ELSE NULL END AS model_version,
  CASE WHEN p_partkey % 8 = 0 THEN 'London' WHEN p_partkey % 8 = 1 THEN 'Paris' WHEN p_partkey % 8 = 2 THEN 'Urumqi'
    WHEN p_partkey % 8 = 3 THEN '' ELSE NULL END AS museum,
  CASE WHEN p_partkey % 4 = 0 THEN p_name || ' note' ELSE NULL END AS notes,
  CAST(p_partkey * 37 % 1440 - 720 AS DOUBLE) AS ui_rotation,
  p_partkey % 10 <> 9 AS has_segmentation,
  CAST(700 + p_partkey * 7 % 900 AS BIGINT) AS image_width, CAST(500 + p_partkey * 11 % 900 AS BIGINT) AS image_height
FROM {{part}}
"""

_CATALOGUE = """
SELECT f.*, d.text AS transcription, o.o_orderdate AS created_at,
  CASE WHEN f.processing_status = 'completed' THEN o.o_orderdate ELSE NULL END AS last_processed_at
FROM {fragments_v} f LEFT JOIN {documents} d ON d.doc_id = f.id LEFT JOIN {orders} o ON o.o_orderkey = f.id
"""

_MATCHES = """
SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS match_id, l_orderkey * 8 + l_linenumber AS line_no, a.fragment_id AS fragment_a_id, b.fragment_id AS fragment_b_id,
  CASE WHEN l_linenumber % 4 = 0 THEN 'left' WHEN l_linenumber % 4 = 1 THEN 'right' WHEN l_linenumber % 4 = 2 THEN 'top' ELSE 'bottom' END
    || '_seg' || CAST(l_linenumber AS VARCHAR(20)) AS edge_a_name,
  CASE WHEN l_suppkey % 4 = 0 THEN 'left' WHEN l_suppkey % 4 = 1 THEN 'right' WHEN l_suppkey % 4 = 2 THEN 'top' ELSE 'bottom' END
    || '_seg' || CAST(l_suppkey % 3 AS VARCHAR(20)) AS edge_b_name,
  round(l_discount + l_tax + l_quantity / 100, 4) AS score, l_linenumber AS rank,
  round(1 / (1 + l_discount + l_tax + l_quantity / 100), 6) AS confidence,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_quantity / 7 - 3, 4) END AS relative_x_cm,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_quantity / 9 - 2, 4) END AS relative_y_cm,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE round(l_tax * 1000 - 40, 4) END AS rotation_deg,
  CASE WHEN l_returnflag = 'A' THEN '1.0' WHEN l_returnflag = 'N' THEN '2.0' ELSE '3.0' END AS algorithm_version
FROM {lineitem}
JOIN {fragments_v} a ON a.id = l_partkey
JOIN {fragments_v} b ON b.id = CASE WHEN l_partkey > l_suppkey THEN l_partkey - l_suppkey - 1 ELSE l_partkey + l_suppkey + 1 END
"""

_DETECTIONS = """
SELECT l_orderkey AS image_id, l_linenumber AS det_no, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS det_id,
  round(l_extendedprice / 1000, 3) AS x1, l_quantity * 10 AS y1,
  round(l_extendedprice / 1000 + 20 + l_tax * 100, 3) AS x2, l_quantity * 10 + 15 AS y2,
  round(CASE WHEN l_discount * 10 > 1 THEN 1 ELSE l_discount * 10 END, 4) AS confidence,
  l_suppkey % 2 AS class_no
FROM {lineitem}
"""

_COUNTS = """
SELECT o.o_orderkey AS image_id, o.o_orderpriority AS annotator, coalesce(l.n, 0) AS truth,
  CASE WHEN coalesce(l.n, 0) + (o.o_orderkey % 5 - 2) < 0 THEN 0 ELSE coalesce(l.n, 0) + (o.o_orderkey % 5 - 2) END AS predicted
FROM {orders} o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""

_ANNOTATIONS = """
SELECT id, CASE WHEN id % 37 = 0 THEN 'missing/' || CAST(id AS VARCHAR(20)) || '.jpg'
    WHEN id % 5 = 0 THEN replace(image_path, '/', chr(92)) ELSE image_path END AS path,
  collection, id % 3 > 0 AS reviewed, id % 13 = 0 AS skipped,
  CASE WHEN id % 41 = 0 THEN NULL ELSE (id * 7) % 3 = 0 END AS has_top_edge,
  CASE WHEN id % 43 = 0 THEN NULL ELSE (id * 3) % 5 = 0 END AS has_bottom_edge,
  CASE WHEN id % 47 = 0 THEN NULL ELSE (id * 5) % 7 < 3 END AS has_left_edge,
  CASE WHEN id % 53 = 0 THEN NULL ELSE (id * 11) % 4 = 0 END AS has_right_edge
FROM {fragments_v}
"""

_OPLOG = """
SELECT event_id AS op_id, event_type AS op_type, value AS duration_ms, event_type <> 'error' AS ok FROM {events}
"""

_HISTORY = """
SELECT CAST(floor(event_id / 250.0) AS BIGINT) AS run, event_id % 250 + 1 AS epoch, round(value / 500, 3) AS score FROM {events}
"""

_PROJECTS = """
SELECT o_orderkey AS id, 'project ' || o_orderpriority AS project_name, o_orderdate AS updated_at FROM {orders}
"""

_PROJECT_FRAGMENTS = """
SELECT CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) AS row_id, l_orderkey AS project_id,
  CASE WHEN l_suppkey % 10 = 3 THEN 'gone' || CAST(l_partkey AS VARCHAR(20)) ELSE f.fragment_id END AS fragment_id,
  l_quantity * 10 AS x, l_tax * 1000 AS y, l_quantity * 4 AS width, l_quantity * 3 AS height,
  l_discount * 100 AS rotation, 1 + l_tax AS scale_x, 1 + l_discount AS scale_y, l_linenumber AS z_index
FROM {lineitem} JOIN {fragments_v} f ON f.id = l_partkey
"""

_TOKENS = """
SELECT conv_id AS image_id, turn AS token_no, length(text) AS x_max,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN '10 CM' WHEN (conv_id + turn) % 7 = 0 THEN ' 5 mm' WHEN (conv_id + turn) % 11 = 0 THEN 'cm/mm' ELSE role END AS text
FROM {conversations}
"""

# Ruler profile of an "image": one value per word of the whole text, the word's length.
_PROFILES = {
    "spark": "SELECT doc_id AS image_id, transform(split(text, ' '), w -> CAST(length(w) * 10 AS DOUBLE)) AS profile FROM {documents}",
    "duck": "SELECT doc_id AS image_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) * 10 AS DOUBLE)) AS profile FROM documents",
}

# Class scores: the whole embedding folded onto five classes (sum of every fifth element).
_LOGITS = {
    "spark": """SELECT vec_id AS image_id, label % 5 AS truth,
  transform(sequence(0, 4), c -> round(aggregate(filter(embedding, (e, i) -> i % 5 = c), CAST(0 AS DOUBLE), (s, e) -> s + CAST(e AS DOUBLE)) * 4, 6)) AS logits FROM {embeddings}""",
    "duck": """SELECT vec_id AS image_id, label % 5 AS truth,
  list_transform(range(5), lambda c: round(list_sum(list_transform(list_filter(embedding, lambda e, i: (i - 1) % 5 = c), lambda e: CAST(e AS DOUBLE))) * 4, 6)) AS logits FROM embeddings""",
}

# Side probabilities in 0..1 and the true sides, from the same vectors.
_SIDES = {
    "spark": """SELECT image_id, image_id % 2 = 0 AS t_top, image_id % 3 = 0 AS t_bottom, image_id % 5 = 0 AS t_left, truth = 1 AS t_right,
  round(1 / (1 + exp(-logits[0])), 4) AS p_top, round(1 / (1 + exp(-logits[1])), 4) AS p_bottom,
  round(1 / (1 + exp(-logits[2])), 4) AS p_left, round(1 / (1 + exp(-logits[3])), 4) AS p_right FROM {logits_v}""",
    "duck": """SELECT image_id, image_id % 2 = 0 AS t_top, image_id % 3 = 0 AS t_bottom, image_id % 5 = 0 AS t_left, truth = 1 AS t_right,
  round(1 / (1 + exp(-logits[1])), 4) AS p_top, round(1 / (1 + exp(-logits[2])), 4) AS p_bottom,
  round(1 / (1 + exp(-logits[3])), 4) AS p_left, round(1 / (1 + exp(-logits[4])), 4) AS p_right FROM logits_v""",
}

_RADIUS = "(400 + 70 * sin(3 * t + id) + 30 * sin(7 * t) + 12 * sin(13 * t + 2 * id))"
_T = "(CAST(i AS DOUBLE) * 6.283185307179586e0 / CAST(360 + id % 64 AS DOUBLE))"


def _ring(axis: str, index: str) -> str:
    centre, wave = ("600", "cos") if axis == "x" else ("500", "sin")
    t = _T.replace("CAST(i AS", f"CAST({index} AS")
    return f"round({centre} + {_RADIUS.replace('t +', t + ' +').replace('* t)', '* ' + t + ')')} * {wave}({t}))"


@F.pandas_udf(T.StructType([T.StructField(axis, T.ArrayType(T.DoubleType())) for axis in ("xs", "ys")]))
def _rings(ids: pd.Series) -> pd.DataFrame:
    """The rings of a batch, as :func:`_ring` states them, all points together; a NULL id has none.  Halves round away from zero."""
    known = ids.notna().to_numpy()
    own = ids[known].to_numpy(np.int64)
    sizes = 360 + np.fmod(own, 64)
    stops = np.cumsum(sizes)
    i, n, id = np.arange(sizes.sum()) - np.repeat(stops - sizes, sizes), np.repeat(sizes, sizes).astype(float), np.repeat(own, sizes)
    t = i * 6.283185307179586 / n
    radius = 400 + 70 * np.sin(3 * t + id) + 30 * np.sin(7 * t) + 12 * np.sin(13 * t + 2 * id)

    def rounded(v: np.ndarray) -> np.ndarray:
        whole = np.rint(v)
        return whole + np.where(np.abs(v - whole) == 0.5, np.sign(v) * (np.abs(whole) < np.abs(v)), 0.0)

    made = {"xs": rounded(600 + radius * np.cos(t)), "ys": rounded(500 + radius * np.sin(t))}
    out = {axis: np.full(len(ids), None, object) for axis in made}
    for axis, values in made.items():
        for row, ring in zip(np.flatnonzero(known), np.split(values, stops[:-1])):
            out[axis][row] = ring
    return pd.DataFrame(out)


def _contours(fragments_v: DataFrame) -> DataFrame:
    head = ("id", "fragment_id", "image_width", "image_height", "scale_unit", "pixels_per_unit", "line_count", "script_type")
    return fragments_v.select(*head, _rings("id").alias("c")).select(*head, "c.xs", "c.ys")


# Closed contours, one row per fragment, whole-pixel points; 360 to 423 points each.
_CONTOURS = {
    "spark": _contours,
    "duck": """SELECT id, fragment_id, image_width, image_height, scale_unit, pixels_per_unit, line_count, script_type,
  CAST(360 + id % 64 AS BIGINT) AS n FROM fragments_v""",
}
_POINTS = {
    "duck": f"""SELECT id, n, i, {_ring('x', 'i')} AS x, {_ring('y', 'i')} AS y
FROM (SELECT id, n, unnest(range(n)) AS i FROM contours_v) q""",
}


def _feature(kind: str, j: str) -> str:
    """Formula features of the edge fixture: value ``j`` of a vector for edge (id, pos)."""
    if kind == "x":
        return f"round(cos(0.05e0 * {j} + 0.37e0 * (id % 17) + 0.9e0 * pos) * (1 + 0.1e0 * sin(0.3e0 * {j} + id)), 6)"
    if kind == "y":
        return f"round(sin(0.07e0 * {j} + 0.21e0 * (id % 13)) * 0.8e0 + 0.1e0 * cos(0.5e0 * {j} + 2 * id), 6)"
    if kind == "f":
        return f"round(abs(sin(1.3e0 * {j} + id % 29)), 6)"
    return f"CAST((id * ({j} + 3) + pos) % 7 AS DOUBLE)"


_EDGE_HEAD = """id * 4 + pos AS edge_id, id, fragment_id, script_type, line_count,
  CASE pos WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' ELSE 'bottom' END AS position,
  CASE pos WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'top' ELSE 'bottom' END || '_seg' || CAST(pos AS VARCHAR(20)) AS edge_name,
  CASE WHEN (id + pos) % 9 = 0 THEN 'border' ELSE 'tear' END AS edge_type,
  round(1 + (id * 13 % 97) / CAST(10 AS DOUBLE) + 0.3e0 * pos, 4) AS length_cm, round(0.5e0 + (id % 23) / CAST(10 AS DOUBLE), 4) AS radius_cm"""


def _edges(array) -> str:
    return f"""{_EDGE_HEAD}, {array('80', 'x')} AS shape_x, {array('80', 'y')} AS shape_y, {array('16', 'f')} AS fourier, {array('8', 'h')} AS histogram"""


_EDGES = {
    "spark": f"""SELECT {_edges(lambda n, k: f"transform(sequence(0, {n} - 1), j -> {_feature(k, 'j')})")}
FROM (SELECT *, explode(sequence(0, 3)) AS pos FROM {{fragments_v}})""",
    "duck": f"""SELECT {_edges(lambda n, k: f"list_transform(range({n}), lambda j: {_feature(k, 'j')})")}
FROM (SELECT *, unnest(range(4)) AS pos FROM fragments_v) q""",
}

VIEWS: dict[str, str | dict] = {
    "fragments_v": _FRAGMENTS,
    "catalogue_v": _CATALOGUE,
    "matches_v": _MATCHES,
    "detections_v": _DETECTIONS,
    "counts_v": _COUNTS,
    "annotations_v": _ANNOTATIONS,
    "oplog_v": _OPLOG,
    "history_v": _HISTORY,
    "projects_v": _PROJECTS,
    "project_fragments_v": _PROJECT_FRAGMENTS,
    "tokens_v": _TOKENS,
    "profiles_v": _PROFILES,
    "logits_v": _LOGITS,
    "sides_v": _SIDES,
    "contours_v": _CONTOURS,
    "points_v": _POINTS,
    "edges_v": _EDGES,
}


SPREAD = {"contours_v": "fragments_v", "edges_v": "fragments_v"}  # views that build much data from each row of their input
ROWS_PER_TASK = 4096


def _text(name: str, dialect: str):
    view = VIEWS[name]
    return view if isinstance(view, str) else view[dialect]


class Source:
    """The supplied tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in TABLES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                view = _text(name, "spark")
                if name in SPREAD:
                    inputs = {SPREAD[name]: self.spread(SPREAD[name])}
                else:
                    inputs = {n: self(n) for n in set(re.findall(r"\{(\w+)\}", view))}
                frame = view(**inputs) if callable(view) else self.spark.sql(view, **inputs)
            self._frames[name] = frame
        return self._frames[name]

    def spread(self, name: str) -> DataFrame:
        """A view over tasks of a bounded number of rows, however many there are; the supplied files are one split each."""
        rows = self(name)
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK)))


def _used(text: str) -> list[str]:
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            for inner in [*_used(re.sub(rf"\b{name}\b", "", _text(name, "duck"))), name]:
                if inner not in found:
                    found.append(inner)
    return found


def sql_with_views(text: str) -> str:
    """Puts the views a check text uses in front of it as common table expressions."""
    body = text.strip()
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _text(n, 'duck')).strip()})" for n in _used(body)]
    if not parts:
        return body
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(parts) + ",\n" + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + ",\n".join(parts) + "\n" + body
