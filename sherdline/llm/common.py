"""What the operators share: table reading, tables kept on shared storage, Arrow batches.

Every operator first selects the columns it needs, so extra columns of the input, whatever their
names, neither clash nor reach the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses do not repeat the work, and a
    lost executor loses nothing.  The files stay until the owner of the folder clears it."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; a null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias("body")


def map_batches(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """``fn`` turns the columns of an Arrow batch, as lists, into the columns of ``schema``."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(names)})
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until it differs from every column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
