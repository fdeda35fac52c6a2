"""A full snapshot against the previous inventory."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(previous: DataFrame, current: DataFrame, key: list[str], compare: list[str], at: str = "observed_at") -> DataFrame:
    """One row per key with its change and new lifecycle.

    previous has lifecycle (active or deleted), inactive_at, first_seen_at,
    last_seen_at and the ``compare`` columns; current has ``at`` and the
    ``compare`` columns. change: registered, updated, reactivated, unchanged,
    deleted, or still_deleted. Being seen again is no update. A deleted row
    keeps its columns and the time when it first went missing.
    """
    now = current.agg(F.max(at).alias("_now"))
    p = previous.select(*key, F.struct(*[c for c in previous.columns if c not in key]).alias("p"))
    c = current.select(*key, F.struct(*[x for x in current.columns if x not in key]).alias("c"))
    # one row: the time of the snapshot, for rows that it lacks
    j = p.join(c, key, "full").join(F.broadcast(now))
    old, new, had, has = F.col("p"), F.col("c"), F.col("p").isNotNull(), F.col("c").isNotNull()
    same = F.lit(True)
    for x in compare:
        same = same & old[x].eqNullSafe(new[x])
    change = (
        F.when(~had, "registered").when(~has & (old["lifecycle"] == "deleted"), "still_deleted").when(~has, "deleted")
        .when(old["lifecycle"] == "deleted", "reactivated").when(same, "unchanged").otherwise("updated")
    )
    return j.select(
        *key, change.alias("change"), F.when(has, "active").otherwise("deleted").alias("lifecycle"),
        F.when(~has, F.coalesce(old["inactive_at"], F.col("_now"))).alias("inactive_at"),
        F.coalesce(old["first_seen_at"], new[at]).alias("first_seen_at"), F.when(has, F.greatest(old["last_seen_at"], new[at])).otherwise(old["last_seen_at"]).alias("last_seen_at"),
        *[F.when(has, new[x]).otherwise(old[x]).alias(x) for x in compare],
    )


def attach_bindings(inventory: DataFrame, bindings: DataFrame, resume: str, fields: list[str]) -> DataFrame:
    """Bindings by résumé identifier, never by title; a binding that is gone is kept but disabled."""
    b = bindings.select(F.col(resume), *[F.col(f).alias(f"_b_{f}") for f in fields], F.col("enabled").alias("_on"), F.lit(True).alias("_bound"))
    j = inventory.join(b, resume, "left")
    out = j.withColumn("enabled", F.coalesce("_on", F.lit(False)))
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_bound"), F.col(f"_b_{f}")).otherwise(F.col(f)))
    return out.drop("_on", "_bound", *[f"_b_{f}" for f in fields])


def sound_snapshot(items: DataFrame, account: list[str], item_id: str) -> DataFrame:
    """Accounts whose inventory is complete: every item has an identifier and none is repeated. The others change nothing."""
    g = items.groupBy(*account).agg(F.count("*").alias("items"), F.count_distinct(item_id).alias("distinct_items"))
    return g.withColumn("sound", F.col("items") == F.col("distinct_items"))


def lifecycle_events(snapshots: DataFrame, sightings: DataFrame, account: list[str], item: str, compare: list[str], at: str = "observed_at") -> DataFrame:
    """Changes of every item over all snapshots of its account at once: account, item, at, change, the ``compare`` columns.

    snapshots(account, at, sound): a snapshot that isn't sound changes nothing,
    nor do its sightings. sightings(account, item, at, compare): an item once a
    snapshot. Sound snapshots of an account are numbered; an item's sightings
    with consecutive numbers are an island. Its first sighting is
    ``registered``, the first after a gap ``reactivated``, another one
    ``updated`` or ``unchanged``; the snapshot after an island's last one is ``deleted``
    with the columns last seen. The same as ``reconcile`` snapshot by snapshot.
    """
    mine = Window.partitionBy(*account)
    numbered = snapshots.filter("sound").select(*account, at).distinct().withColumn("_k", F.row_number().over(mine.orderBy(at)))
    numbered = numbered.withColumn("_after", F.lead(at).over(mine.orderBy(at)))
    seen = sightings.select(*account, item, at, *compare).join(numbered, [*account, at])
    w = Window.partitionBy(*account, item).orderBy("_k")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    gap = F.col("_k") - F.lag("_k").over(w)
    change = F.when(gap.isNull(), "registered").when(gap > 1, "reactivated").when(same, "unchanged").otherwise("updated")
    ends = F.coalesce(F.lead("_k").over(w) > F.col("_k") + 1, F.lit(True)) & F.col("_after").isNotNull()
    seen = seen.withColumns({"change": change, "_gone": F.when(ends, F.col("_after"))})
    values = [F.col(c) for c in compare]
    gone = F.when(F.col("_gone").isNotNull(), F.struct(F.col("_gone").alias("t"), F.lit("deleted").alias("change")))
    events = F.filter(F.array(F.struct(F.col(at).alias("t"), "change"), gone), lambda x: x.isNotNull())
    return seen.select(*account, item, F.explode(events).alias("_e"), *values).select(*account, item, F.col("_e.t").alias(at), "_e.change", *compare)


def lifecycle_state(events: DataFrame, account: list[str], item: str, compare: list[str], at: str = "observed_at") -> DataFrame:
    """The inventory after all events: account, item, lifecycle, inactive_at, first_seen_at, last_seen_at, the ``compare`` columns as last seen."""
    there = F.col("change") != "deleted"
    last = F.max_by(F.struct(F.col("change"), F.col(at).alias("t"), *compare), at)
    g = events.groupBy(*account, item).agg(last.alias("_l"), F.min(F.when(there, F.col(at))).alias("first_seen_at"), F.max(F.when(there, F.col(at))).alias("last_seen_at"))
    gone = F.col("_l.change") == "deleted"
    return g.select(*account, item, F.when(gone, "deleted").otherwise("active").alias("lifecycle"), F.when(gone, F.col("_l.t")).alias("inactive_at"), "first_seen_at", "last_seen_at", *[F.col(f"_l.{c}").alias(c) for c in compare])


def reconciliation_audit(events: DataFrame, account: list[str], item: str, at: str = "observed_at") -> DataFrame:
    """What one reconciliation changed, a row per account and snapshot with changes: sorted identifiers registered, updated, reactivated and deleted."""
    lists = [F.array_sort(F.collect_list(F.when(F.col("change") == c, F.col(item)))).alias(f"{c}_ids") for c in ("registered", "updated", "reactivated", "deleted")]
    return events.filter("change <> 'unchanged'").groupBy(*account, at).agg(*lists)
