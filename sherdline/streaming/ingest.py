"""Streaming ingest: new files become pending catalogue rows, once per fragment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model_outputs import needs_processing
from ..sources.readers import read_or_empty

TABLE_SCHEMA = "fragment_id string, image_path string, processing_status string, to_score array<string>, run string, batch_id long"

#: Catalogue fields that tell which scorers a row still needs.
SCORED_FIELDS = (
    "line_detection_model_version", "script_type", "script_type_classification_model_version", "segmentation_coords", "segmentation_model_version",
    "line_count", "classification_model_version", "scale_unit", "scale_model_version", "has_circle",
)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, to_rows, table: str, checkpoint: str, files_per_batch: int = 50,
    scorers: Mapping[str, str] | None = None,
):
    """Starts the stream over the Parquet files of ``folder`` and returns the running query.

    ``to_rows`` maps the stream, row by row, to ``fragment_id, image_path`` and any of ``SCORED_FIELDS``.  A
    fragment comes in with the first batch that names it, by the least path that batch has for it; a NULL
    ``fragment_id`` or path names no fragment.  ``scorers`` maps scorer kinds to versions: ``to_score`` lists those that
    :func:`needs_processing` picks for the row, fields that ``to_rows`` does not give being NULL.

    Which fragments are known is keyed state in RocksDB, of one small row each, so a batch reads none of the
    rows that earlier ones wrote.  All rows of a batch bear its time; a fragment whose rows all bear one time is new.
    A batch writes its own partition of ``table``, under the id that the checkpoint gives the stream: one that
    runs again overwrites what it wrote, and a stream with a new checkpoint leaves the older streams' rows and
    takes their fragments as known.  Two streams must not write one table at the same time.
    """
    todo = F.array_compact(F.array(*[F.when(needs_processing(k, v), F.lit(k)) for k, v in sorted((scorers or {}).items())])).cast("array<string>")
    rows = to_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    given = [c for c in SCORED_FIELDS if c in rows.columns]
    named = rows.filter(F.col("fragment_id").isNotNull() & F.col("image_path").isNotNull())
    first = named.withColumn("at", F.current_timestamp()).groupBy("fragment_id").agg(
        F.min("at").alias("from"), F.max("at").alias("to"), F.min(F.struct("image_path", *given)).alias("row")
    )
    fresh = first.filter(F.col("from") == F.col("to")).select("fragment_id", "row.*").withColumns(
        {c: F.lit(None).cast("string") for c in SCORED_FIELDS if c not in given}
    )
    fresh = fresh.select("fragment_id", "image_path", F.lit("pending").alias("processing_status"), todo.alias("to_score"))
    others: dict[str, bool] = {}  # whether other streams wrote to the table, asked once by each start

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        if run not in others:
            others[run] = not older(session, run).isEmpty()
        kept = batch.join(older(session, run), "fragment_id", "left_anti") if others[run] else batch
        kept = kept.withColumn("run", F.lit(run)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch_id").parquet(table)

    def older(session: SparkSession, run: str) -> DataFrame:
        return read_or_empty(session, table, TABLE_SCHEMA).filter(F.col("run") != run).select("fragment_id")

    writer = (
        fresh.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)  # the stream takes its own copy of the settings when it starts
    try:
        return writer.start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def pending(spark: SparkSession, table: str) -> DataFrame:
    """The rows that no scorer has seen yet."""
    return read_or_empty(spark, table, TABLE_SCHEMA).filter(F.col("processing_status") == "pending")
