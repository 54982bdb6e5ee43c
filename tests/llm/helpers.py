"""Rows for the tests of the training-data operators."""

from pyspark.sql import DataFrame

#: Columns of ``documents`` and extra ones whose names the operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp string, mask string, value string, body string, unit string, "
    "repeats string, kept string, base string, spans string, term string, words string, hashes string, at string, license string, entry string"
)
SMALL = "/root/testdata/sf0.001"


def make_docs(spark, rows) -> DataFrame:
    extra = ["x"] * (len(SCHEMA.split(", ")) - 5)
    return spark.createDataFrame([(i, t, None, "src", None if t is None else len(t), *extra) for i, t in rows], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
