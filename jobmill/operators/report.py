"""Counts, roll-ups and lists for reports."""

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def daily_counts(df: DataFrame, ts: str, cutoff: str, days: int = 30, by: list[str] = ()) -> DataFrame:
    """Rows a day over the days before the cutoff."""
    c = F.lit(cutoff).cast("timestamp")
    recent = df.filter((F.col(ts) >= c - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) < c))
    return recent.groupBy(F.to_date(ts).alias("day"), *by).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Per group, a map from reason to count, keys in order."""
    c = df.filter(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("_n"))
    return c.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "_n")))).alias("reasons"))


def merge_maps(df: DataFrame, by: list[str], reasons: str) -> DataFrame:
    """Per group, maps of counts added key by key."""
    e = df.select(*by, F.explode(reasons).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_n"))
    return e.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias("reasons"))


def roll_up(runs: DataFrame, by: list[str], counters: list[str], cap: Column | None = None, used: str | None = None, last: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Summed counters per group and number of runs; with a cap, what is left of it. ``last``, ``out: (column, order)``: its newest value that isn't null, such as why an account is paused."""
    newest_known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(o))).alias(name) for name, (c, o) in (last or {}).items()]
    g = runs.groupBy(*by).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in counters], *newest_known)
    return g if cap is None else g.withColumn("quota_left", F.greatest(cap - F.col(used), F.lit(0)))


def discovery_counters(observations: DataFrame, run: list[str], item: str, max_unique: int) -> DataFrame:
    """Per run: observations, distinct items, how many of them are selected, whether some were cut off."""
    g = observations.groupBy(*run).agg(F.count("*").alias("search_observation_count"), F.count_distinct(item).alias("unique_vacancy_count"))
    return g.withColumns({"candidate_count": F.least("unique_vacancy_count", F.lit(max_unique)), "truncated": F.col("unique_vacancy_count") > max_unique})


def observe_summary(attempts: DataFrame, run: list[str], status: str, work_items: str, captcha: Column, fetched: str = "fetched", failed: str = "failed") -> DataFrame:
    """Per run of observation: attempts, fetched, work items, failures, whether a CAPTCHA stopped it. Nothing is ever submitted."""
    return attempts.groupBy(*run).agg(
        F.count("*").alias("full_fetch_attempted"), F.count_if(F.col(status) == fetched).alias("full_fetched"), F.coalesce(F.sum(work_items), F.lit(0)).alias("evaluation_candidate_count"),
        F.count_if(F.col(status) == failed).alias("failed"), F.coalesce(F.bool_or(captcha), F.lit(False)).alias("stopped_on_captcha"))


def apply_summary(outcomes: DataFrame, run: list[str], status: str, attempted: Column) -> DataFrame:
    """Per batch of applications: submitted (confirmed ones too), confirmed, external writes, failures, and the quota used, the greater of submissions and writes."""
    s = F.col(status)
    g = outcomes.groupBy(*run).agg(
        F.count_if(s.isin("submitted", "confirmed")).alias("submitted"), F.count_if(s == "confirmed").alias("confirmed"), F.count_if(attempted).alias("external_writes_attempted"), F.count_if(s == "failed").alias("failed"))
    return g.withColumn("quota_consumed", F.greatest("submitted", "external_writes_attempted"))


def load_report(runs: DataFrame, eligible: Column, selected: Column, loaded: Column, failed: Column) -> DataFrame:
    """One row: runs discovered, eligible, pending (eligible and not loaded before they were selected), selected, loaded, failed."""
    return runs.agg(
        F.count("*").alias("discovered"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & ~F.coalesce(loaded & ~selected, F.lit(False))).alias("pending"),
        F.count_if(selected).alias("selected"), F.count_if(selected & loaded).alias("loaded"), F.count_if(selected & failed).alias("failed"))


def summary_checks(headers: DataFrame, rows: DataFrame, run: list[str], declared: str) -> DataFrame:
    """Declared count of each run against counted rows; runs without rows count 0, without a summary are incomplete."""
    c = rows.groupBy(*run).agg(F.count("*").alias("counted"))
    j = headers.join(c, run, "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return j.withColumn("status", F.when(F.col(declared).isNull(), "incomplete").when(F.col(declared) == F.col("counted"), "agrees").otherwise("differs"))


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top n; a top-k heap per task."""
    return df.orderBy(*order).limit(n)


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(f.cast("double")).alias(name) for name, f in flags.items()])


def conversion_by_letter(letters: DataFrame, outcomes: DataFrame, key: list[str], by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Shares of outcomes by what the letter was made with, such as template and résumé: letters(key, by), outcomes(key). A letter without an outcome counts as none of the flags."""
    j = letters.select(*key, *by).join(outcomes, key, "left")
    return rates(j, by, {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()})


def latency(df: DataFrame, by: list[str], start: str, end: str, points: list[float]) -> DataFrame:
    """Exact percentiles of whole days between two times: the first day up to which a share of the group's rows lie; rows without both times don't count.

    Rows are counted by group and day first, so a window holds one row a day.
    """
    days = df.groupBy(*by, F.datediff(end, start).alias("_day")).agg(F.count("*").alias("_n")).filter(F.col("_day").isNotNull())
    w = Window.partitionBy(*by)
    run = days.withColumns({"_upto": F.sum("_n").over(w.orderBy("_day")), "_all": F.sum("_n").over(w)})
    # k of n rows are p of them: compared as 100000 * k >= 100000 p * n, in whole numbers
    at = [F.min(F.when(F.col("_upto") * 100_000 >= F.col("_all") * round(p * 100_000), F.col("_day"))).alias(f"p{round(100 * p)}") for p in points]
    return run.groupBy(*by).agg(F.sum("_n").alias("n"), *at)


def not_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def already_skipped(df: DataFrame, skipped: DataFrame, vacancy: str, resume: str, wildcard: str = "") -> DataFrame:
    """Rows whose (résumé, vacancy), or vacancy with the wildcard résumé, was skipped before: two equal joins, no OR in a join."""
    pair = skipped.filter(F.col(resume) != wildcard).select(vacancy, resume).distinct()
    every = skipped.filter(F.col(resume) == wildcard).select(vacancy).distinct()
    whole = df.join(every, vacancy, "left_semi")
    return whole.unionByName(df.join(every, vacancy, "left_anti").join(pair, [vacancy, resume], "left_semi"))


def stored(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, below ``spark.checkpoint.dir``; where that is unset, one process alone may use a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def area_tree(areas: DataFrame, area: str, parent: str, name: str) -> DataFrame:
    """Areas below the roots: path (names from the root), depth, and the name indented by two spaces a level.

    Identifiers are distinct; a null parent makes a root. Areas whose parent is
    missing, and those on or below a cycle, are left out with all below them.
    Each round doubles the stretch that a path covers, so a tree of depth d
    takes about log2(d) joins, each stored before the next one.
    """
    rows = stored(areas.select(F.col(area), F.col(name), F.col(parent).alias("_above"), F.array(name).alias("path")))
    open_ = F.col("_above").isNotNull()
    left = rows.filter(open_).count()
    while left:
        up = rows.select(F.col(area).alias("_id"), F.col("_above").alias("_next"), F.col("path").alias("_path"))
        moved = rows.filter(open_).join(up, F.col("_above") == F.col("_id"))
        rows = stored(rows.filter(~open_).unionByName(moved.select(area, name, F.col("_next").alias("_above"), F.concat("_path", "path").alias("path"))))
        before, left = left, rows.filter(open_).count()
        if left == before:  # any line that ends would have lost an area to its root in this round
            break
    depth = F.size("path") - 1
    return rows.filter(~open_).select(area, name, depth.alias("depth"), "path", F.concat(F.repeat(F.lit("  "), depth), F.col(name)).alias("label"))


def traceback_lines(lines: DataFrame, log: list[str], pos: str, text: str, after: str, last: int = 1000, span: int = 1 << 16) -> DataFrame:
    """Lines of tracebacks of each log, at most the ``last`` ones of it: the log's columns, ``pos``, ``text``, and ``place`` (0 for the line before a head, 1 else).

    A traceback begins at its head and ends before the next line with a time; it
    counts if the last time before it isn't before ``after``. The line before
    each head comes with it, again if it was part of a traceback itself.

    A log is one sequence, but no task holds it: positions (whole numbers) are
    cut into spans of ``span``. Each span is summed up first: its last time, whether a head
    follows it, its last line. Windows over spans carry these into the next
    span, windows within a span do the rest.
    """
    c = lines.select(*log, pos, text).withColumns({
        "_span": F.floor(F.col(pos) / span), "_time": F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)), "_head": F.col(text).startswith("Traceback (most recent call last):")})
    part = [*log, "_span"]
    spans = c.groupBy(*part).agg(
        F.max_by("_time", F.when(F.col("_time").isNotNull(), F.col(pos))).alias("_time"), F.max(F.when(F.col("_time").isNotNull(), F.col(pos))).alias("_at"),
        F.max(F.when(F.col("_head"), F.col(pos))).alias("_head_at"), F.max_by(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")), pos).alias("_line"))
    before = Window.partitionBy(*log).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *part, F.last("_time", ignorenulls=True).over(before).alias("_in_time"), F.coalesce(F.max("_head_at").over(before) > F.max("_at").over(before), F.lit(False)).alias("_in_open"), F.last("_line").over(before).alias("_in_line"))
    c = c.join(spans, part)
    w = Window.partitionBy(*part).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({
        "_now": F.coalesce(F.last("_time", ignorenulls=True).over(upto), F.col("_in_time")), "_last_time": F.max(F.when(F.col("_time").isNotNull(), F.col(pos))).over(upto), "_last_head": F.max(F.when(F.col("_head"), F.col(pos))).over(upto),
        "_prev": F.coalesce(F.lag(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))).over(w), F.col("_in_line"))})
    open_ = F.when(F.col("_last_head").isNotNull(), F.col("_last_time").isNull() | (F.col("_last_head") > F.col("_last_time"))).otherwise(F.col("_last_time").isNull() & F.col("_in_open"))
    fresh = F.coalesce(F.col("_now") >= F.lit(after).cast("timestamp"), F.lit(False))
    own = F.when(open_, F.struct(F.lit(1).alias("place"), F.col(pos).alias("_p"), F.col(text).alias("_t")))
    lead = F.when(F.col("_head"), F.struct(F.lit(0).alias("place"), F.col("_prev.p").alias("_p"), F.col("_prev.t").alias("_t")))
    kept = c.filter(fresh).select(*log, F.col(pos).alias("_from"), F.explode(F.filter(F.array(lead, own), lambda x: x.isNotNull())).alias("x"))
    rank = F.row_number().over(Window.partitionBy(*log).orderBy(F.desc("_from"), F.desc("x.place")))
    return kept.withColumn("_rank", rank).filter(F.col("_rank") <= last).select(*log, F.col("_from").alias("head_or_line"), F.col("x._p").alias(pos), F.col("x._t").alias(text), "x.place")
