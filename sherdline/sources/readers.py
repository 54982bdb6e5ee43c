"""Reading listings, annotations, labels and logs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from ..operators.relations import SIDES

_IMAGE = r"(?i)\.(jpg|jpeg|png)$"
_ANNOTATIONS = "annotations map<string, struct<{}, reviewed: string, skipped: string, notes: string, updated_at: string>>".format(
    ", ".join(f"{s}: boolean" for s in SIDES)
)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Paths under ``root``, relative to it, without reading the files' content.  The root is plain text,
    whatever characters it holds; listed paths are full ones and begin with it but for a scheme."""
    escaped = re.sub(r"([\\{}\[\]*?])", r"\\\1", root)  # characters that a path pattern would read otherwise
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(escaped).select("path", "length")
    base = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root.rstrip("/")) + "/"
    start = F.locate(base, F.col("path")) + F.lit(len(base))
    return files.select(F.expr("path").substr(start, F.length("path")).alias("path"), F.col("length").alias("size"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none yet."""
    return _or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def new_fragments(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """Image paths as catalogue rows: id is the file name without its extension, the first path of an id
    wins, ids already there are passed over."""
    path = normalize_path(F.col("path"))
    images = listing.filter(path.rlike(_IMAGE)).select(
        F.regexp_replace(F.element_at(F.split(path, "/"), -1), _IMAGE, "").alias("fragment_id"), path.alias("image_path")
    )
    first = images.groupBy("fragment_id").agg(F.min("image_path").alias("image_path"))
    return first.join(existing.select("fragment_id"), "fragment_id", "left_anti").withColumn("processing_status", F.lit("pending"))


def parse_annotations(stores: DataFrame, text: str = "value") -> DataFrame:
    """Annotation stores (JSON text with an object keyed by path) as rows; a label that is not a boolean
    is NULL, missing fields get their defaults.  Of the spellings of one path in a store the last counts."""
    truthy = lambda c: F.coalesce(~F.col(c).isin("", "false", "0"), F.lit(False))
    rows = stores.select(F.posexplode(F.from_json(text, _ANNOTATIONS)["annotations"]).alias("place", "path", "r"))
    last = rows.groupBy(normalize_path(F.col("path")).alias("path")).agg(F.max_by("r", "place").alias("r")).select("path", "r.*")
    return last.select(
        "path", *SIDES, truthy("reviewed").alias("reviewed"), truthy("skipped").alias("skipped"),
        F.coalesce("notes", F.lit("")).alias("notes"), "updated_at",
    )


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    return parse_annotations(spark.read.text(path, wholetext=True))


def load_label_csv(spark: SparkSession, path: str, label: str, label_type: str = "int") -> DataFrame:
    """CSV with the columns ``File Name`` and ``label`` (such as ``Line Count`` or ``Script Type``)."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("File Name").alias("file_name"), F.col(label).try_cast(label_type).alias("label"))


def load_label_txt(spark: SparkSession, path: str) -> DataFrame:
    """Box label files: the number of non-blank lines per file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return lines.groupBy(F.regexp_replace("file_name", r"\.txt$", "").alias("image")).agg(
        F.count_if(F.trim("value") != "").alias("boxes")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file, block and a number that follows the order in the block; none without a file."""

    def read() -> DataFrame:
        return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    lines = _or_empty(spark, read, "value string, file string, block long")
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def scan_log_errors(lines: DataFrame, sample: int = 10) -> DataFrame:
    """One row: lines holding ERROR or CRITICAL, and the first of them, trimmed.

    ``lines`` has ``line_no, value``, and ``file, block`` where there are several files, which then come in
    the order of their names.  Only the sample, a handful of rows, is put together.
    """
    bad = lines.filter(F.col("value").rlike("ERROR|CRITICAL"))
    order = [c for c in ("file", "block", "line_no") if c in lines.columns]
    first = bad.orderBy(*order).limit(sample).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(*order, F.trim("value").alias("line")))), lambda r: r["line"])
    )
    return bad.agg(F.count(F.lit(1)).alias("error_lines")).withColumn("sample", first.scalar())
