"""Delta sweeps, upserts, dirty sets, ledgers and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dijkstone.operators.ranking import first_per_key


def delta_sweep(items: DataFrame, key: str, ts: str, order: str, since=None, where: Column | None = None) -> DataFrame:
    """The newest row of each key among those at or after ``since`` (rows without a time stay). Input order plays no part:
    nothing stops at the first old item. Ties keep the first in ``order``."""
    rows = items.where(where) if where is not None else items
    if since is not None:
        rows = rows.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(since)))
    return first_per_key(rows, [key], [F.col(ts).desc_nulls_last(), F.col(order)])


def load_status(results: DataFrame, group: str, ok: str) -> DataFrame:
    """Per group: rows, failures and a status (ok, deels, gefaald); one bad group doesn't stop the others."""
    n, bad = F.count("*"), F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    return results.groupBy(group).agg(n.alias("n"), bad.alias("n_failed"), F.when(bad == 0, "ok").when(bad == n, "gefaald").otherwise("deels").alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], how: str = "update") -> DataFrame:
    """``old`` with ``new``: nothing (the first wins), update (the new row wins), fill (new values that aren't null win)."""
    if how == "nothing":
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    if how == "update":
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(n, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def skip_known(items: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Versions never change: what is loaded isn't loaded again."""
    return items.join(loaded.select(*keys).distinct(), keys, "left_anti")


def gap_fill(items: DataFrame, snapshot: DataFrame, key: str, sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """Items that the snapshot lacks, with a value from the first source that has one."""
    out = items.join(snapshot.select(key).distinct(), key, "left_anti")
    for i, (source, value) in enumerate(sources):
        out = out.join(source.select(key, F.col(value).alias(f"__v{i}")), key, "left")
    named = [f"__v{i}" for i in range(len(sources))]
    return out.withColumn("value", F.coalesce(*named)).drop(*named)


def dirty_set(current: DataFrame, stored: DataFrame, scope: list[str], hash_col: str = "hash") -> DataFrame:
    """(scope, state): new, changed or orphan scopes; equal ones are left out."""
    s = stored.select(*scope, F.col(hash_col).alias("__old"))
    both = current.select(*scope, hash_col).join(s, scope, "full")
    state = F.when(F.col("__old").isNull(), "new").when(F.col(hash_col).isNull(), "orphan").when(F.col(hash_col) != F.col("__old"), "changed")
    return both.select(*scope, state.alias("state")).where("state is not null")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, op: str, order: str, default: str | None = None) -> DataFrame:
    """A table after its change set (toevoegen, wijzigen, verwijderen). A change without an operation takes ``default``, or is skipped."""
    c = changes.withColumn(op, F.coalesce(op, F.lit(default))) if default else changes.where(F.col(op).isNotNull())
    last = first_per_key(c, [key], [F.col(order).desc()])
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(op) != "verwijderen").select(*base.columns))


def pending_days(days: DataFrame, ledger: DataFrame, day: str = "day") -> DataFrame:
    """Days that the ledger doesn't have as done: a restarted load goes on where it stopped."""
    return days.join(ledger.where("status = 'ok'").select(day).distinct(), day, "left_anti")


def presence(df: DataFrame, key: str, first: str, last: str, start: str, end: str, step: str = "2 months") -> DataFrame:
    """(key, axis, present): for each date of the axis whether the row exists then."""
    axis = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"interval {step}"))
    return df.select(key, F.explode(axis).alias("axis"), first, last).select(key, "axis", F.col("axis").between(F.to_date(first), F.to_date(last)).alias("present"))
