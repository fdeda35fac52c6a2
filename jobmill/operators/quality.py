"""Data-quality rules with violation counts, duplicates, fingerprints."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, rows): rows for which a rule isn't true, null counting as a violation. One scan for all rules."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])
    return counts.select(F.explode(pairs).alias("p"), "_rows").select("p.rule", "p.violations", F.col("_rows").alias("rows"))


def quarantine(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per broken rule: the ``keep`` columns and the rule."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), r) for r, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of child whose non-null reference has no parent."""
    p = parent.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct()
    known = child
    for a in on:
        known = known.filter(F.col(a).isNotNull())
    return known.join(p, list(on), "left_anti")


def catalogue_signature(catalogue: DataFrame, pos: str, key: str, by: list[str]) -> DataFrame:
    """Per catalogue: SHA-256 of its keys in order as compact JSON. A catalogue is one profile's configuration; its list is one value."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct(pos, key))), lambda x: x[key])
    return catalogue.groupBy(*by).agg(F.sha2(F.to_json(keys).cast("binary"), 256).alias("signature"), F.count("*").alias("size"))


def rowset_fingerprint(df: DataFrame, columns: list[str], leaf: int = 4096) -> DataFrame:
    """One row: n, and a SHA-256 over all rows whatever their order; any row changed, added, repeated or gone changes it.

    A digest tree: rows are digested as JSON lists of texts (null is not the text of null),
    sorted within ranges of the first hexadecimal digits, two a level, so
    many that a range holds about ``leaf`` rows; each range has a digest over its
    sorted digests, each level one over its ranges'. No task holds more than a range or 256 digests.
    """
    row = F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).cast("binary"), 256)
    rows = df.select(row.alias("d"))
    n = rows.count()
    levels, held = 0, n
    while held > leaf:
        levels, held = levels + 1, held // 256

    def up(nodes: DataFrame, digits: int) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "")
        return nodes.groupBy(F.substring("at", 1, digits).alias("_to")).agg(F.sha2(joined.cast("binary"), 256).alias("d")).select(F.col("_to").alias("at"), "d")

    nodes = rows.withColumn("at", F.col("d"))
    for level in range(levels, 0, -1):
        nodes = up(nodes, 2 * level)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "")
    return nodes.agg(F.sha2(joined.cast("binary"), 256).alias("fingerprint")).select(F.lit(n).cast("long").alias("n"), "fingerprint")


def hex64(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def in_order(*times: Column) -> Column:
    """Each time isn't before the last; absent ones are passed over."""
    ok = F.lit(True)
    for a, b in zip(times, times[1:], strict=False):
        ok = ok & F.coalesce(b >= a, F.lit(True))
    return ok


def run_sound(status: Column, started_at: Column, finished_at: Column) -> Column:
    """A known status, no end before the start, and an end where the run is finished."""
    known = status.isin("running", "incomplete", "finished")
    return known & F.coalesce(finished_at >= started_at, F.lit(True)) & ((status != "finished") | finished_at.isNotNull())


def claim_sound(status: Column, attempts: Column, claimed_at: Column, changed_at: Column, submitted_at: Column, finished_at: Column) -> Column:
    """A known status, an attempt at least, and no time before the claim."""
    after = F.forall(F.array(changed_at, submitted_at, finished_at), lambda x: x.isNull() | (x >= claimed_at))
    return status.isin("CLAIMED", "SUBMITTING", "SUBMITTED", "UNCERTAIN", "FAILED_SAFE_TO_RETRY") & (attempts >= 1) & changed_at.isNotNull() & after


def payload_id_sound(payload_id: Column, path_id: Column) -> Column:
    """A posting lies below its own identifier."""
    return payload_id.cast("string").eqNullSafe(path_id.cast("string"))


def counters_sound(*counters: Column) -> Column:
    return F.forall(F.array(*counters), lambda x: x.isNull() | (x >= 0))


def lifecycle_sound(lifecycle: Column, present: Column, inactive_at: Column) -> Column:
    return lifecycle.isin("active", "deleted") & F.when(lifecycle == "active", present & inactive_at.isNull()).otherwise(~present & inactive_at.isNotNull())


def rotation_sound(size: Column, start: Column, next_: Column, window: Column, wrapped: Column) -> Column:
    """Offsets of a query window lie in the catalogue and agree with each other."""
    inside = (size > 0) & start.between(0, size - 1) & next_.between(0, size - 1) & window.between(1, size)
    return inside & (next_ == F.pmod(start + window, size)) & (wrapped == (start + window >= size))
