"""A run of several scorers in which later ones see what earlier ones wrote."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

OUTCOME = "outcome"


@dataclass(frozen=True, eq=False)
class Scorer:
    """One scorer of a run.

    ``run`` gives the value of each written field as a column over the fields read, or maps rows of key and
    fields read to rows of key, ``success`` and the fields written, one for each key it has seen.
    ``picks`` holds for the rows that it must see, ``success`` (column scorers) for those it manages; NULL is
    false in both.  A row that fails writes ``on_failure`` only, unless ``run`` names what a row writes in a
    further column ``wrote`` (an array of field names).  A field that is written as NULL is NULL afterwards.
    """

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    run: Mapping[str, Column] | Callable[[DataFrame], DataFrame]
    picks: Column | None = None
    success: Column | None = None
    on_failure: tuple[str, ...] = ()


def stages(scorers: Sequence[Scorer]) -> list[list[Scorer]]:
    """The scorers by the earliest stage they can run in, order kept inside a stage.

    A scorer comes after those before it that write what it reads.  It is never earlier than one before it
    that reads or writes a field it writes, so that a stage may read its input and merge in the given order.
    """
    level: list[int] = []
    for i, scorer in enumerate(scorers):
        at = 0
        for before, placed in zip(scorers[:i], level):
            if set(before.writes) & set(scorer.reads):
                at = max(at, placed + 1)
            elif set(before.writes + before.reads) & set(scorer.writes):
                at = max(at, placed)
        level.append(at)
    return [[s for s, at in zip(scorers, level) if at == n] for n in range(max(level, default=-1) + 1)]


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _wrote(scorer: Scorer, success: Column) -> Column:
    return F.when(success, _texts(scorer.writes)).otherwise(_texts(scorer.on_failure))


def _in_place(scorer: Scorer, rows: DataFrame) -> Column:
    """The result of a column scorer; naming a field that it does not declare as read is an error."""
    success = F.lit(True) if scorer.success is None else F.coalesce(scorer.success, F.lit(False))
    picks = F.lit(True) if scorer.picks is None else scorer.picks
    values = [scorer.run[f].alias(f) for f in scorer.writes]
    result = F.when(picks, F.struct(success.alias("success"), _wrote(scorer, success).alias("wrote"), F.struct(*values).alias("values")))
    rows.select(result)  # analysed only
    return result


def _by_key(scorer: Scorer, rows: DataFrame, key: str, name: str) -> DataFrame:
    """The results of a scorer over rows, one for each key (of several the greatest)."""
    out = scorer.run(rows if scorer.picks is None else rows.filter(scorer.picks))
    success = F.coalesce("success", F.lit(False))
    wrote = F.coalesce(F.col("wrote"), _texts([])) if "wrote" in out.columns else _wrote(scorer, success)
    result = F.struct(success.alias("success"), wrote.alias("wrote"), F.struct(*scorer.writes).alias("values"))
    return out.groupBy(F.col(key).alias("__key")).agg(F.max(result).alias(name))


def staged_run(fragments: DataFrame, scorers: Sequence[Scorer], key: str = "id") -> DataFrame:
    """The fragments after all scorers, with a struct ``outcome`` of ``ok, ran, failed, updated``.

    A scorer sees the fields as those before it left them, and is asked again whether it must run.  Of several
    that write a field the last one counts; what failing scorers write counts as well.  ``ok``: any scorer
    succeeded (false if none ran).  ``ran`` and ``failed`` list scorers in the order of their stages, ``updated`` the
    fields written.  Fields keep their type, new ones are added.  Rows with a NULL key meet column scorers only;
    rows that share a key share the results of the others.  Nothing is written; that is up to the caller.

    Column scorers cost no shuffle.  A scorer over rows costs a join by the key, and the rows are cut before
    its stage, since it reads them beside the join.
    """
    if OUTCOME in fragments.columns:
        raise ValueError(f"the fragments have a column {OUTCOME!r} already")
    df = fragments.withColumns({f"__{n}": _texts([]) for n in ("ran", "failed", "updated")})
    for stage in stages(scorers):
        if any(callable(s.run) for s in stage):
            df = cut(df)
        names = {s: f"__result_{i}" for i, s in enumerate(stage)}
        seen = {s: df.select(key, *[f for f in s.reads if f != key]) for s in stage}
        met = df.withColumns({names[s]: _in_place(s, seen[s]) for s in stage if not callable(s.run)})
        for s in stage:
            if callable(s.run):
                results = _by_key(s, seen[s], key, names[s])
                met = met.join(results, met[key] == results["__key"], "left").drop("__key")
        df = _merged(met, df, stage, names)
    ok = F.size("__ran") > F.size("__failed")
    outcome = F.struct(
        ok.alias("ok"), F.col("__ran").alias("ran"), F.col("__failed").alias("failed"), F.array_sort(F.array_distinct("__updated")).alias("updated")
    )
    return df.withColumn(OUTCOME, outcome).drop("__ran", "__failed", "__updated")


def _merged(met: DataFrame, before: DataFrame, stage: list[Scorer], names: dict[Scorer, str]) -> DataFrame:
    """One stage's results laid over the fields, in the order of the scorers."""
    fields: dict[str, Column] = {}
    for s in stage:
        result = F.col(names[s])
        for f in s.writes:
            value = result["values"][f]
            known = f in before.columns
            old = fields.get(f, F.col(f) if known else F.lit(None))
            new = value.cast(before.schema[f].dataType) if known else value
            fields[f] = F.when(F.coalesce(F.array_contains(result["wrote"], f), F.lit(False)), new).otherwise(old)
    ran = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(s.name)) for s, n in names.items()]))
    failed = F.array_compact(F.array(*[F.when(~F.col(n)["success"], F.lit(s.name)) for s, n in names.items()]))
    wrote = F.concat(*[F.coalesce(F.col(n)["wrote"], _texts([])) for n in names.values()])
    tracks = {"__ran": F.concat("__ran", ran), "__failed": F.concat("__failed", failed), "__updated": F.concat("__updated", wrote)}
    return met.withColumns(fields | tracks).drop(*names.values())


def dry_run(fragments: DataFrame, scorers: Sequence[Scorer], key: str = "id") -> DataFrame:
    """What a run would do: ``key, ok, ran, failed, updated`` and ``changed``, the fields that would differ (sorted)."""
    fields = sorted({f for s in scorers for f in s.writes})
    known = [f for f in fields if f in fragments.columns]
    kept = fragments.withColumns({f"__was_{f}": F.col(f) for f in known})
    after = staged_run(kept, scorers, key)
    was = {f: F.col(f"__was_{f}") if f in known else F.lit(None) for f in fields}
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(was[f]), F.lit(f)) for f in fields])).cast("array<string>")
    return after.select(key, f"{OUTCOME}.*", changed.alias("changed"))
