"""From search results to routed work items."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def values_in_order(df: DataFrame, key: list[str], pos: str, value: str, out: str) -> DataFrame:
    """key, out: distinct non-null values of each key by their first position. Only distinct values are gathered, however many rows a key has."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(pos).alias("_p"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", value))), lambda x: x[value]).alias(out))


def first_by_position(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row per key, the one with the smallest position."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def union_candidates(observations: DataFrame, key: list[str], pos: str, item: list[str], ordered: dict[str, str]) -> DataFrame:
    """One row per key: the items of the first observation, and for each ``out: column`` its distinct values in order."""
    first = [F.min_by(c, pos).alias(c) for c in item]
    out = observations.groupBy(*key).agg(*first, F.min(pos).alias("first_pos"), F.count("*").alias("observations"))
    for name, c in ordered.items():
        out = out.join(values_in_order(observations, key, pos, c, name), key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{observations.schema[c].dataType.simpleString()}>")))
    return out


def page_completeness(pages: DataFrame, request: list[str], page: str, total: str) -> DataFrame:
    """Per request: pages seen, pages declared, whether all are there and the declaration is sound."""
    g = pages.groupBy(*request).agg(F.count_distinct(page).alias("seen"), F.max(page).alias("last_page"), F.max(total).alias("declared"), F.min(total).alias("_least"))
    sound = F.col("_least").isNotNull() & (F.col("_least") >= 0) & (F.col("_least") == F.col("declared"))
    return g.withColumns({"complete": F.coalesce(sound & (F.col("seen") >= F.col("declared")) & (F.col("last_page") + 1 >= F.col("declared")), F.lit(False))}).drop("_least")


def explode_pages(pages: DataFrame, request: list[str], page: str, items: str, item_id: str) -> DataFrame:
    """Items of search pages, each identifier once per request, first occurrence by (page, place)."""
    e = pages.select(*request, page, F.posexplode(items).alias("place", "item"))
    return e.groupBy(*request, F.col("item")[item_id].alias("item_id")).agg(F.min_by(F.struct(page, "place", "item"), F.struct(page, "place")).alias("_r")).select(*request, "item_id", "_r.*")


def technical_caps(candidates: DataFrame, run: list[str], pos: str, max_unique: int, max_fetch: int, stop: str | None = None) -> DataFrame:
    """Adds rank, kept, and status: attempted, technical_limit, account_paused or beyond_unique.

    Positions are distinct within a run. After a row whose ``stop`` is true,
    the rows that follow are account_paused. Runs are bounded by their page
    limits; one run is one group.
    """
    w = Window.partitionBy(*run).orderBy(pos)
    df = candidates.withColumn("rank", F.row_number().over(w))
    paused = F.coalesce(F.max(F.col(stop)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) if stop else F.lit(False)
    status = F.when(F.col("rank") > max_unique, "beyond_unique").when(paused, "account_paused").when(F.col("rank") > max_fetch, "technical_limit").otherwise("attempted")
    return df.withColumn("kept", F.col("rank") <= max_unique).withColumn("status", status)


def circular_window(catalogue: DataFrame, pos: str, n: int | Column, start: int | Column, size: int) -> DataFrame:
    """``size`` entries from position ``start`` on, going round; with their place in the window. ``n``: entries of the catalogue."""
    n = n if isinstance(n, Column) else F.lit(n)
    return catalogue.withColumn("place", F.pmod(F.col(pos) - start, n)).filter(F.col("place") < F.least(F.lit(size), n))


def fan_out(fetched: DataFrame, bindings: DataFrame, account: list[str], matched_keys: str, matched_sets: str, key_sets: str, resume_sets: str, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Every fetched posting with every active binding of its account, with the overlap of their query sets: work items, asked for by who wants the rows.

    Overlap never filters. ``key_sets`` maps a query key to its set. Bindings
    are counted first: up to ``broadcast_bytes`` (as texts) they are broadcast
    and no posting moves; beyond it both sides are shuffled by account, with a
    posting's account split by AQE. The rows are postings times bindings of an
    account by definition; ``fan_out_counts`` has their counts without them.
    """
    size = bindings.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    j = fetched.join(F.broadcast(bindings) if size <= broadcast_bytes else bindings, account)
    shared_sets = F.filter(matched_sets, lambda s: F.array_contains(F.col(resume_sets), s))
    shared_keys = F.filter(matched_keys, lambda k: F.coalesce(F.array_contains(F.col(resume_sets), F.element_at(F.col(key_sets), k)), F.lit(False)))
    return j.withColumns({"overlap_sets": shared_sets, "overlap_keys": shared_keys}).withColumn("has_overlap", F.size("overlap_sets") > 0)


def fan_out_counts(fetched: DataFrame, bindings: DataFrame, account: list[str], matched_keys: str, matched_sets: str, key_sets: str, resume_sets: str) -> DataFrame:
    """Per account with both: items, overlapping (items whose query sets meet), shared_keys (keys shared, summed over items); no item is formed.

    Postings and bindings are counted by their combination of sets. Sets are an
    inverted index: combinations of both sides that share a set meet there, each pair of
    combinations once, and counts multiply. Shared keys are counts of keys of a
    set times counts of bindings that have the set.
    """
    p = fetched.groupBy(*account, F.array_sort(F.array_distinct(matched_sets)).alias("_m")).agg(F.count("*").alias("_p"))
    b = bindings.groupBy(*account, F.array_sort(F.array_distinct(resume_sets)).alias("_r")).agg(F.count("*").alias("_b"))
    items = p.groupBy(*account).agg(F.sum("_p").alias("_p")).join(b.groupBy(*account).agg(F.sum("_b").alias("_b")), account).select(*account, (F.col("_p") * F.col("_b")).alias("items"))
    left, right = p.select("*", F.explode("_m").alias("_set")), b.select("*", F.explode("_r").alias("_set"))
    met = left.join(right, [*account, "_set"]).groupBy(*account, "_m", "_r").agg(F.first("_p").alias("_p"), F.first("_b").alias("_b"))
    met = met.groupBy(*account).agg(F.sum(F.col("_p") * F.col("_b")).alias("overlapping"))
    keys = fetched.select(*account, key_sets, F.explode(matched_keys).alias("_k")).groupBy(*account, F.element_at(F.col(key_sets), F.col("_k")).alias("_set")).agg(F.count("*").alias("_k"))
    having = right.groupBy(*account, "_set").agg(F.sum("_b").alias("_b"))
    shared = keys.join(having, [*account, "_set"]).groupBy(*account).agg(F.sum(F.col("_k") * F.col("_b")).alias("shared_keys"))
    out = items.join(met, account, "left").join(shared, account, "left")
    return out.select(*account, "items", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overlapping", "shared_keys")])


def fan_out_completeness(expected: DataFrame, actual: DataFrame, group: list[str], member: str) -> DataFrame:
    """Per group: missing, unexpected and repeated members; complete when there are none."""
    e = expected.select(*group, member).distinct().withColumn("_e", F.lit(1))
    a = actual.groupBy(*group, member).agg(F.count("*").alias("_a"))
    j = e.join(a, [*group, member], "full")
    g = j.groupBy(*group).agg(
        F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("_a") > 1).alias("repeated"))
    return g.withColumn("complete", (F.col("missing") + F.col("unexpected") + F.col("repeated")) == 0)


def matches_snapshot(items: DataFrame, bindings: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Work items against the binding snapshot: verdict ok, unknown, or the first field that differs."""
    b = bindings.select(*on, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_known"))
    j = items.join(b, on, "left")
    verdict = F.when(F.col("_known").isNull(), "unknown")
    for f in fields:
        verdict = verdict.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), f"{f}_differs")
    return j.withColumn("verdict", verdict.otherwise("ok")).drop("_known", *[f"_b_{f}" for f in fields])


def agree(left: DataFrame, right: DataFrame, on: list[str], equal: list[str], ordered: list[tuple[str, str]] = ()) -> DataFrame:
    """left joined with right on keys; rules: each of ``equal`` is the same on both sides, each pair (earlier in left, later in right) in time order."""
    r = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in {*equal, *(b for _, b in ordered)}])
    j = left.join(r, on)
    rules = [F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), f"{c}_differs") for c in equal]
    rules += [F.when(F.col(a) > F.col(f"_r_{b}"), f"{b}_before_{a}") for a, b in ordered]
    return j.withColumn("violations", F.filter(F.array(*rules), lambda x: x.isNotNull())).drop(*[c for c in r.columns if c.startswith("_r_")])


def projections_agree(observed: DataFrame, items: DataFrame, key: list[str], pos: str, fields: dict[str, str]) -> DataFrame:
    """observed(key, one array per field) against the work items of the key in order of ``pos``: names of the fields that differ.

    fields: ``array column: item column``. A key without items is compared with
    empty lists; items whose key was never observed are ``unobserved``.
    """
    lists = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(pos, *dict.fromkeys(fields.values())))).alias("_items"))
    j = observed.withColumn("_seen", F.lit(True)).join(lists, key, "full")
    none = F.array().cast(items.select(F.array(F.struct(pos, *dict.fromkeys(fields.values())))).schema[0].dataType)
    j = j.withColumn("_items", F.coalesce("_items", none))

    def of(c: str) -> Column:
        return F.transform("_items", lambda x: x[c])

    rules = [F.when(F.col("_seen") & ~F.col(a).eqNullSafe(of(b)), f"{a}_differs") for a, b in fields.items()]
    found = F.filter(F.array(F.when(F.col("_seen").isNull(), "unobserved"), *rules), lambda x: x.isNotNull())
    return j.select(*key, found.alias("violations"))


def uris_resolve(sidecars: DataFrame, keys: DataFrame, on: list[str], uris: dict[str, str], relative) -> DataFrame:
    """Sidecar rows with the names of those URIs that don't resolve to the object key that is there.

    uris: ``URI column of sidecars: key column of keys``; a null URI is not
    asked for. ``relative`` turns a URI into a key.
    """
    there = keys.select(*on, *[F.col(c).alias(f"_k_{c}") for c in uris.values()])
    j = sidecars.join(there, on, "left")
    rules = [F.when(F.col(u).isNotNull() & ~relative(F.col(u)).eqNullSafe(F.col(f"_k_{c}")), f"{u}_mismatch") for u, c in uris.items()]
    return j.select(*on, F.filter(F.array(*rules), lambda x: x.isNotNull()).alias("violations"))


def ordered_union(refs: DataFrame, queries: DataFrame, set_key: str = "query_set_key", set_pos: str = "set_pos", query_pos: str = "query_pos") -> DataFrame:
    """Enabled queries of the referenced sets in order of first reference; a repeated set counts once."""
    sets = refs.groupBy(set_key).agg(F.min(set_pos).alias(set_pos))
    return queries.filter("enabled").join(sets, set_key).orderBy(set_pos, query_pos)


def unknown_sets(refs: DataFrame, queries: DataFrame, set_key: str = "query_set_key") -> DataFrame:
    return refs.join(queries.select(set_key).distinct(), set_key, "left_anti")


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def negotiation_evidence(pages: DataFrame, wanted: DataFrame, pair: list[str], details: list[str]) -> DataFrame:
    """For each wanted pair: found, and the details of all exact matches in order."""
    j = wanted.select(*pair).distinct().join(pages.select(*pair, *details), pair, "left")
    matches = F.array_sort(F.collect_list(F.when(F.col(details[0]).isNotNull(), F.struct(*details))))
    return j.groupBy(*pair).agg(matches.alias("matches")).withColumn("found", F.size("matches") > 0)


def matched_skills(vacancy: DataFrame, resume: DataFrame, vacancy_key: list[str], resume_key: list[str], skill: str, pos: str, form, most: int = 3) -> DataFrame:
    """First shared skills of each pair in the vacancy's spelling and order, compared by ``form``."""
    v = vacancy.select(*vacancy_key, F.col(skill).alias("_s"), F.col(pos).alias("_p"), form(F.col(skill)).alias("_f")).filter("_f <> ''")
    v = v.groupBy(*vacancy_key, "_f").agg(F.min(F.struct("_p", "_s")).alias("_v"))
    r = resume.select(*resume_key, form(F.col(skill)).alias("_f")).filter("_f <> ''").distinct()
    shared = [c for c in vacancy_key if c in resume_key]
    j = v.join(r, [*shared, "_f"])
    keys = list(dict.fromkeys([*vacancy_key, *resume_key]))
    return j.groupBy(*keys).agg(F.slice(F.transform(F.array_sort(F.collect_list("_v")), lambda x: x["_s"]), 1, most).alias("skills"))
