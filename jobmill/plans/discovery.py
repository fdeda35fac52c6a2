"""Search pages and audits of the raw tree: from landed pages to candidates with their lineage, checked against what the run says of itself."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmill.plans.backfill import typed
from jobmill.sources.raw import relative_key

PAGE_KEY = r"/discovery/queries/query=([^/]+)/page=(\d+)\.json$"


def page_rows(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, items) of the landed search pages.

    pages: run_id, key, query_key, page, error (``invalid_search_payload`` where items is there and no list, ``after_invalid``
    for later pages of such a query). items, of pages without error: run_id,
    key, query_key, page, place, vacancy_id, item (JSON). What is no object, or has no id, is no item.
    """
    body = F.col("body").cast("string")
    p = objects.filter("kind = 'page'").select("run_id", "key", F.regexp_extract("key", PAGE_KEY, 1).alias("query_key"), F.regexp_extract("key", PAGE_KEY, 2).cast("int").alias("page"), F.get_json_object(body, "$.items").alias("_items"), F.json_object_keys(body).isNull().alias("_broken"))
    p = p.withColumn("_bad", F.col("_broken") | F.coalesce(~F.col("_items").startswith("["), F.lit(False)))
    # pages of one query of one run, which its page limit bounds
    p = p.withColumn("_first_bad", F.min(F.when(F.col("_bad"), F.col("page"))).over(Window.partitionBy("run_id", "query_key")))
    error = F.when(F.col("_bad") & (F.col("page") == F.col("_first_bad")), "invalid_search_payload").when(F.col("page") >= F.col("_first_bad"), "after_invalid")
    p = p.withColumn("error", error)
    items = p.filter("error is null").select("run_id", "key", "query_key", "page", F.posexplode(F.from_json("_items", "array<string>")).alias("place", "item"))
    items = items.withColumn("vacancy_id", F.trim(F.get_json_object("item", "$.id"))).filter(F.col("item").startswith("{") & (F.coalesce("vacancy_id", F.lit("")) != ""))
    return p.select("run_id", "key", "query_key", "page", "error"), items


def candidates(items: DataFrame, queries: DataFrame) -> DataFrame:
    """run_id, vacancy_id, item (of its first page), query_keys, query_sets, page_keys (each in order of first sight), first_pos, observations.

    queries(run_id, query_key, query_set, query_pos): the run's queries in the order in which they ran. Pages of other queries don't count.
    """
    # by run alone, so that all steps keep to one shuffle
    ran = queries.groupBy("run_id").agg(F.collect_list(F.struct(F.col("query_key").alias("_key"), "query_set", "query_pos")).alias("_ran"))
    seen = items.join(ran, "run_id").withColumn("_q", F.explode(F.filter("_ran", lambda q: q["_key"] == F.col("query_key")))).select(*items.columns, "_q.query_set", "_q.query_pos").withColumn("pos", F.struct("query_pos", "page", "place"))
    by_page = seen.groupBy("run_id", "vacancy_id", "query_key", "query_set", "key").agg(F.min("pos").alias("pos"), F.min_by("item", "pos").alias("item"), F.count("*").alias("n"))
    # a run's pages bound the list
    sights = F.array_sort(F.collect_list(F.struct("pos", "query_key", "query_set", "key")))
    g = by_page.groupBy("run_id", "vacancy_id").agg(F.min_by("item", "pos").alias("item"), F.min("pos").alias("first_pos"), F.sum("n").alias("observations"), sights.alias("l"))

    def listed(c: str, out: str) -> Column:
        return F.array_distinct(F.filter(F.col(f"l.{c}"), lambda x: x.isNotNull())).alias(out)

    return g.select("run_id", "vacancy_id", "item", listed("query_key", "query_keys"), listed("query_set", "query_sets"), listed("key", "page_keys"), "first_pos", "observations")


def discoveries(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed discovery objects, queries of each run in order) from the landed tree."""
    d = typed(objects.filter("kind = 'run'"), "discovery", "discovery")
    q = d.select("run_id", F.posexplode("v.query_pages").alias("i", "p")).groupBy("run_id", F.col("p.query_key").alias("query_key")).agg(F.min("i").alias("query_pos"), F.min_by("p.query_set", "i").alias("query_set"))
    return d, q


def lineage_violations(objects: DataFrame, bucket: str, prefix: str, observed: DataFrame | None = None) -> DataFrame:
    """(run_id, key, rule) where a run's discovery object, or an observation of it, disagrees with the landed pages.

    Rules: ``page_uri`` (a page is named that isn't there), ``counts``,
    ``vacancies`` (other identifiers, or in another order), ``lineage`` (other query keys, sets or
    pages of one), ``page_error`` (an invalid page that the run doesn't
    report), and for observed(run_id, vacancy_id, key, o) ``observation_lineage``.
    """
    d, queries = discoveries(objects)
    pages, items = page_rows(objects)
    found = candidates(items, queries)

    def at(uri: Column) -> Column:
        return relative_key(uri, bucket, prefix)["key"]

    head = d.select("run_id", "key", "v")
    broken = [d.select("run_id", "key", F.explode("violations").alias("rule"))]
    named = head.select("run_id", "key", F.explode("v.query_pages").alias("p")).withColumn("_page", at(F.col("p.uri")))
    there = pages.select("run_id", F.col("key").alias("_page"), F.lit(True).alias("_there"))
    broken.append(named.join(there, ["run_id", "_page"], "left").filter("_there is null").select("run_id", "key", F.lit("page_uri").alias("rule")).distinct())
    counted = found.groupBy("run_id").agg(F.sum("observations").alias("n"), F.count("*").alias("unique"), F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "vacancy_id"))), lambda x: x["vacancy_id"]).alias("ids"))
    j = head.join(counted, "run_id", "left").na.fill(0, ["n", "unique"])
    same = (F.col("v.search_observation_count") == F.col("n")) & (F.col("v.unique_vacancy_count") == F.col("unique")) & (F.col("v.truncated_by_max_unique") == (F.col("v.selected_candidate_count") < F.col("unique")))
    broken.append(j.filter(~F.coalesce(same, F.lit(False))).select("run_id", "key", F.lit("counts").alias("rule")))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    broken.append(j.filter(~F.transform("v.vacancies", lambda x: x["vacancy_id"]).eqNullSafe(ids)).select("run_id", "key", F.lit("vacancies").alias("rule")))

    told = head.select("run_id", "key", F.explode("v.vacancies").alias("x")).select("run_id", "key", F.col("x.vacancy_id").alias("vacancy_id"), F.col("x.matched_query_keys").alias("a"), F.col("x.matched_query_sets").alias("b"), F.transform("x.query_page_uris", at).alias("c"))
    differ = ~(F.col("a").eqNullSafe(F.col("query_keys")) & F.col("b").eqNullSafe(F.col("query_sets")) & F.col("c").eqNullSafe(F.col("page_keys")))
    lineage = found.select("run_id", "vacancy_id", "query_keys", "query_sets", "page_keys")
    broken.append(told.join(lineage, ["run_id", "vacancy_id"]).filter(differ).select("run_id", "key", F.lit("lineage").alias("rule")).distinct())
    reported = head.select("run_id", "key", F.transform(F.filter("v.query_errors", lambda e: e["reason"] == "invalid_search_payload"), lambda e: e["query_key"]).alias("_reported"))
    bad = pages.filter("error = 'invalid_search_payload'").select("run_id", "query_key").join(reported, "run_id")
    broken.append(bad.filter(~F.coalesce(F.array_contains("_reported", F.col("query_key")), F.lit(False))).select("run_id", "key", F.lit("page_error").alias("rule")).distinct())
    if observed is not None:
        told = observed.select("run_id", "vacancy_id", "key", F.col("o.matched_query_keys").alias("a"), F.col("o.matched_query_sets").alias("b"), F.transform("o.query_page_uris", at).alias("c")).join(head.select("run_id"), "run_id", "left_semi")
        j = told.join(lineage, ["run_id", "vacancy_id"], "left")
        broken.append(j.filter(differ).select("run_id", "key", F.lit("observation_lineage").alias("rule")))
    out = broken[0]
    for b in broken[1:]:
        out = out.unionByName(b)
    return out


def reconciliations(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, inventories, quarantine) from the landed audits of résumé reconciliation.

    changes: run_id, account_key, profile, at, resume_id, change (one row per listed
    identifier). inventories: run_id, account_key, profile, at and the columns of each résumé.
    """
    t = typed(objects.filter("kind = 'run'"), "resume_reconciliation", "resume_reconciliation")
    good = t.filter(F.size("violations") == 0).select("run_id", F.col("v.account_key").alias("account_key"), F.col("v.source_profile").alias("profile"), F.try_to_timestamp("v.reconciled_at").alias("at"), "v")

    def changed(c: str) -> Column:
        return F.transform(f"v.{c}_ids", lambda x: F.struct(x.alias("resume_id"), F.lit(c).alias("change")))

    lists = F.array(*map(changed, ("registered", "updated", "reactivated", "deleted")))
    changes = good.select("run_id", "account_key", "profile", "at", F.explode(F.flatten(lists)).alias("x")).select("run_id", "account_key", "profile", "at", "x.*")
    inventories = good.select("run_id", "account_key", "profile", "at", F.explode("v.resumes").alias("x")).select("run_id", "account_key", "profile", "at", "x.*")
    return changes, inventories, t.select("run_id", "key", F.explode("violations").alias("rule"))
