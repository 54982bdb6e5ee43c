"""Staged runs against a plain loop over fragments and scorers."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sherdline.operators.staged import Scorer, dry_run, staged_run, stages

ROWS = [
    (1, None, None, 3), (2, 5, "s", 0), (3, None, "t", 7), (4, 2, None, None), (5, 9, "s", 12), (5, 9, "s", 12), (None, 1, None, 4),
]
SCHEMA = "id long, line_count int, script_type string, dots int"


def count_rows(rows):
    """Half the dots; an odd number of dots fails and leaves an error, none gives no result."""
    odd = F.col("dots") % 2 == 1
    return rows.filter("dots IS NOT NULL").select(
        "id", (~odd).alias("success"), F.when(~odd, (F.col("dots") / 2).cast("long")).alias("line_count"),
        F.when(odd, F.concat(F.lit("odd "), F.col("dots"))).alias("error"),
    )


def scorers():
    return [
        Scorer("count", ("line_count", "dots"), ("line_count", "error"), count_rows, F.col("line_count").isNull() | (F.col("line_count") > 4), on_failure=("error",)),
        Scorer("wide", ("dots",), ("wide",), {"wide": F.col("dots") > 5}),
        Scorer(
            "script", ("line_count", "script_type"), ("script_type",), {"script_type": F.concat(F.lit("n"), F.col("line_count"))},
            F.col("script_type").isNull() | (F.col("line_count") == 6), F.col("line_count").isNotNull(),
        ),
        Scorer("wipe", ("script_type",), ("script_type", "error"), {"script_type": F.lit(None).cast("string"), "error": F.lit("wiped")}, F.col("script_type") == "n6"),
    ]


def plainly(row):
    """One fragment after another scorer, as a loop would have it."""
    r = dict(zip(("id", "line_count", "script_type", "dots"), row), error=None, wide=None)
    ran, failed, wrote = [], [], set()

    def done(name, ok, updates):
        ran.append(name)
        if not ok:
            failed.append(name)
        r.update(updates)
        wrote.update(updates)

    if r["id"] is not None and r["dots"] is not None and (r["line_count"] is None or r["line_count"] > 4):
        if r["dots"] % 2:
            done("count", False, {"error": f"odd {r['dots']}"})
        else:
            done("count", True, {"line_count": r["dots"] // 2, "error": None})
    done("wide", True, {"wide": None if r["dots"] is None else r["dots"] > 5})
    if r["script_type"] is None or r["line_count"] == 6:
        done("script", r["line_count"] is not None, {} if r["line_count"] is None else {"script_type": f"n{r['line_count']}"})
    if r["script_type"] == "n6":
        done("wipe", True, {"script_type": None, "error": "wiped"})
    return r, ran, failed, sorted(wrote)


def test_staged_run_equals_a_loop(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("extra", F.lit("kept"))
    out = staged_run(df, scorers())
    assert out.columns == ["id", "line_count", "script_type", "dots", "extra", "error", "wide", "outcome"]
    assert [out.schema[c].dataType.simpleString() for c in ("line_count", "script_type")] == ["int", "string"]
    got, want = [], []
    for r in out.collect():
        o = r["outcome"]
        got.append(({c: r[c] for c in ("id", "line_count", "script_type", "dots", "error", "wide")}, sorted(o["ran"]), o["failed"], o["updated"], o["ok"]))
    for row in ROWS:
        r, ran, failed, wrote = plainly(row)
        want.append((r, sorted(ran), failed, wrote, len(ran) > len(failed)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_dry_run_tells_what_would_change(spark):
    df = spark.createDataFrame(ROWS[:5], SCHEMA)
    got = {r["id"]: (r["ok"], r["changed"]) for r in dry_run(df, scorers()).collect()}
    want = {}
    for row in ROWS[:5]:
        r, ran, failed, _ = plainly(row)
        old = dict(zip(("id", "line_count", "script_type", "dots"), row))
        want[row[0]] = (len(ran) > len(failed), sorted(f for f in r if r[f] != old.get(f)))
    assert got == want


def test_stages_follow_what_is_read():
    made = lambda name, reads, writes: Scorer(name, tuple(reads), tuple(writes), {})
    a, b, c, d, e = made("a", "x", "p"), made("b", "x", "q"), made("c", "p", "r"), made("d", "x", "r"), made("e", "q", "x")
    assert [[s.name for s in stage] for stage in stages([a, b, c, d, e])] == [["a", "b"], ["c", "d", "e"]]
    assert stages([]) == []


def test_nothing_runs_and_misuse(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r["outcome"]["ok"] for r in staged_run(df, []).collect()} == {False}
    never = Scorer("never", ("dots",), ("wide",), {"wide": F.lit(True)}, F.lit(None).cast("boolean"))
    rows = staged_run(df, [never]).collect()
    assert len(rows) == len(ROWS) and all(not r["outcome"]["ok"] and r["outcome"]["ran"] == [] and r["wide"] is None for r in rows)
    assert staged_run(df.limit(0), scorers()).collect() == []
    with pytest.raises(AnalysisException):
        staged_run(df, [Scorer("sly", ("dots",), ("wide",), {"wide": F.col("line_count") > 1})])
    with pytest.raises(ValueError, match="outcome"):
        staged_run(df.withColumn("outcome", F.lit(1)), scorers())
