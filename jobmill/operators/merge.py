"""Merges of change feeds into current state: one row per key, each column by its policy.

Plain Parquet has no MERGE. A merge is the union of current rows and changes,
one aggregate per key, and a new snapshot. Every feed carries an arrival
sequence ``seq`` that breaks ties.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Arrival numbers of a chunk of one key's history.
CHUNK = 1 << 16


def change_feed(*feeds: DataFrame) -> DataFrame:
    """Partial and full observations as one feed; columns that a feed lacks are null."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def newest(feed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order``; the last of equal ones must be told apart by the last order column. Nulls replace too."""
    rest = [c for c in feed.columns if c not in key]
    return feed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def last_write(feed: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    return newest(feed, key, [seq])


def coalesce_merge(
    feed: DataFrame, key: list[str], ts: str, seq: str, keep: list[str], replace: list[str] = (), full_only: list[str] = (), is_full: str | None = None,
    first: dict[str, str] | None = None, last: dict[str, str] | None = None, mode: str = "arrival", chunk: Column | None = None,
) -> DataFrame:
    """One row per key from a feed of partial and full rows.

    keep: newest non-null value, but a full row's null replaces. replace: value
    of the newest row, null included. full_only: from full rows only. first and
    last: ``out: column`` with the least and greatest value.

    mode ``arrival``: a row counts only if its time isn't older than the newest
    time that arrived before it, so a late older row never fills a null.
    mode ``event_time``: order of arrival has no effect except between equal times.

    In ``arrival`` mode a key's history is not one group: ``chunk`` (of a whole
    ``seq``, CHUNK numbers each; else to be given, and never falling as seq grows) divides it. Newest times of
    chunks come first, then running ones within a chunk.
    """
    full = F.col(is_full) if is_full else F.lit(False)
    if mode == "arrival":
        feed = _not_older(feed, key, ts, seq, chunk)
        order: Column = F.col(seq)
    elif mode == "event_time":
        feed = feed.withColumn("_ok", F.lit(True))
        order = F.struct(ts, seq)
    else:
        raise ValueError(f"unknown mode {mode}")
    ok = F.col("_ok")

    def at_newest(c: str, allowed: Column) -> Column:
        return F.max_by(F.when(allowed, F.struct(F.col(c).alias("v"))), F.when(allowed, order))["v"].alias(c)

    out = [at_newest(c, ok & (full | F.col(c).isNotNull())) for c in keep]
    out += [at_newest(c, ok) for c in replace]
    out += [at_newest(c, ok & full) for c in full_only]
    out += [F.min(c).alias(o) for o, c in (first or {}).items()] + [F.max(c).alias(o) for o, c in (last or {}).items()]
    return feed.groupBy(*key).agg(*out)


def _not_older(feed: DataFrame, key: list[str], ts: str, seq: str, chunk: Column | None) -> DataFrame:
    """Adds _ok: the row's time isn't older than the newest before it in order of seq."""
    if chunk is None:
        if not isinstance(feed.schema[seq].dataType, IntegralType):
            raise ValueError(f"{seq} is no whole number: give the chunk of a row")
        chunk = F.floor(F.col(seq) / CHUNK)
    feed = feed.withColumn("_chunk", chunk)
    before = Window.partitionBy(*[f"_c_{c}" for c in key]).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = feed.groupBy(*[F.col(c).alias(f"_c_{c}") for c in key], "_chunk").agg(F.max(ts).alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(before)).filter(F.col("_before").isNotNull()).drop("_top").withColumnRenamed("_chunk", "_c")
    # only chunks that follow another of their key have a row here: none for most keys
    on = F.col("_chunk").eqNullSafe(F.col("_c"))
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    inside = Window.partitionBy(*key, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    newest_before = F.greatest(F.max(ts).over(inside), F.col("_before"))
    return feed.join(tops, on, "left").withColumn("_ok", F.col(ts) >= F.coalesce(newest_before, F.col(ts)))


def reconciled_merge(feed: DataFrame, key: list[str], order: list[str], first: str, last: str) -> DataFrame:
    """The newest row of each key in full, nulls too, with the least ``first`` and the greatest ``last`` of all its rows."""
    ends = feed.groupBy(*key).agg(F.min(first).alias(first), F.max(last).alias(last))
    return newest(feed, key, order).drop(first, last).join(ends, key)


def applications_from(events: DataFrame, event_type: str = "event_type", failed: str = "failed") -> DataFrame:
    """Outcomes that may become applications: a failed one never does."""
    return events.filter(F.coalesce(F.col(event_type) != failed, F.lit(False)))


def run_merge(feed: DataFrame, key: list[str], seq: str, status: str, config: list[str], counters: list[str], started: str, finished: str, regress: bool = False) -> DataFrame:
    """Run rows: configuration of the last write, last non-null counters, earliest start.

    Without ``regress`` a finished run stays finished; with it, status is the last one written.
    """
    last = [F.max_by(F.struct(F.col(c).alias("v")), seq)["v"].alias(c) for c in config]
    known = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in [*counters, finished]]
    end = F.max_by(status, seq) if regress else F.when(F.bool_or(F.col(status) == "finished"), "finished").otherwise(F.max_by(status, seq))
    return feed.groupBy(*key).agg(*last, *known, F.min(started).alias(started), end.alias(status))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], seq: str, never: list[str] = ("created_at", "updated_at")) -> DataFrame:
    """Last change per key over the current rows; key and ``never`` columns keep their current value; columns without a change stay."""
    given = [c for c in changes.columns if c not in {*key, seq}]
    new = newest(changes, key, [seq]).select(*key, *[F.col(c).alias(f"_n_{c}") for c in given], F.lit(True).alias("_new"))
    j = current.withColumn("_old", F.lit(True)).join(new, key, "full")
    out = []
    for c in [c for c in current.columns if c not in key]:
        if c not in given:
            out.append(F.col(c))
        elif c in never:
            out.append(F.coalesce(c, f"_n_{c}").alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return j.select(*key, *out)


def whole_runs(rows: DataFrame, quarantine: DataFrame, run: list[str]) -> DataFrame:
    """Rows of runs without a quarantined row: a run is loaded whole or not at all, and does not stop the others."""
    return rows.join(quarantine.select(*run).distinct(), run, "left_anti")


def replace_runs(current: DataFrame, loaded: DataFrame, run: list[str]) -> DataFrame:
    """Current state with the loaded runs' rows in place of older ones, so a replay adds nothing."""
    return current.join(loaded.select(*run).distinct(), run, "left_anti").unionByName(loaded)
