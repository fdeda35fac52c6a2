"""More registered queries, one or a few operators each, on whole tables of the driver; each with its DuckDB SQL."""

from pyspark.sql import functions as F

from jobmill.functions import text as T
from jobmill.operators import accounts, mapping, merge, quality, reconcile, report, routing, rules, state
from jobmill.operators.spread import spread
from jobmill.plans.queries import DEMO, _TAGGED, _demo_decision, _titled, query
from jobmill.sources import raw

def _none():
    return F.lit(None).cast("string")


# --- routing and runs ------------------------------------------------------


@query("""
with e as (select l_orderkey, l_linenumber % 3 as page, l_partkey as item_id, row_number() over (partition by l_orderkey, l_linenumber % 3 order by l_linenumber, l_partkey) - 1 as place from lineitem)
select l_orderkey, item_id, min(page)::int as page, arg_min(place, page * 1000 + place)::int as place from e group by 1, 2""")
def page_items(t):
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("id"))))
    p = t("lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("page")).agg(items.alias("items"))
    return routing.explode_pages(p, ["l_orderkey"], "page", "items", "id").select("l_orderkey", "item_id", "page", "place")


@query("""
with b as (select s_suppkey, s_nationkey, s_name from supplier where s_acctbal >= 0)
select case when b.s_suppkey is null then 'unknown' when c_nationkey is distinct from s_nationkey then 'nation_differs' when o_orderstatus is distinct from 'O' then 'status_differs' else 'ok' end as verdict, count(*) as n
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey left join b on b.s_suppkey = l_suppkey group by 1""")
def binding_snapshot(t):
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    items = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(o.select("o_orderkey", "nation", F.col("o_orderstatus").alias("status")), "o_orderkey")
    b = t("supplier").filter("s_acctbal >= 0").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.lit("O").alias("status"))
    return routing.matches_snapshot(items, b, ["s_suppkey"], ["nation", "status"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
with i as (select l_orderkey as k, list(l_partkey order by l_linenumber, l_partkey) as parts, list(l_returnflag order by l_linenumber, l_partkey, l_returnflag) as flags from lineitem group by 1),
o as (select l_orderkey as k, list(l_partkey order by l_linenumber, l_partkey) as parts, list(l_linestatus order by l_linenumber, l_partkey, l_returnflag) as flags from lineitem group by 1)
select o_orderkey, array_to_string(list_filter([case when o.parts is distinct from i.parts then 'parts_differs' end, case when coalesce(o.flags, []) is distinct from coalesce(i.flags, []) then 'flags_differs' end], lambda x: x is not null), ',') as violations
from orders left join i on i.k = o_orderkey left join o on o.k = o_orderkey""")
def observation_projections(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("pos"), "l_partkey", "l_returnflag", "l_linestatus")
    seen = li.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "l_partkey", "l_linestatus"))).alias("x"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    o = t("orders").select("o_orderkey").join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.transform("x", lambda x: x["l_partkey"]), none("bigint")).alias("parts"), F.coalesce(F.transform("x", lambda x: x["l_linestatus"]), none("string")).alias("flags"))
    return routing.projections_agree(o, li, ["o_orderkey"], "pos", {"parts": "l_partkey", "flags": "l_returnflag"}).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("""
select o_orderkey, case when o_orderpriority = '5-LOW' then '' when c_mktsegment || '/' || c_nationkey is distinct from case when c_acctbal >= 0 then c_mktsegment || '/' || c_nationkey end then 'uri_mismatch' else '' end as violations
from orders join customer on c_custkey = o_custkey""")
def sidecar_uris(t):
    c = t("customer").withColumn("key", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")))
    keys = t("orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.when(F.col("c_acctbal") >= 0, F.col("key")).alias("key"), F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("store://bucket/"), "key")).alias("uri"))
    out = routing.uris_resolve(keys.select("o_orderkey", "uri"), keys.select("o_orderkey", "key"), ["o_orderkey"], {"uri": "key"}, lambda u: F.replace(u, F.lit("store://bucket/"), F.lit("")))
    return out.select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("select distinct l_orderkey, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)")
def unknown_query_sets(t):
    refs = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    return routing.unknown_sets(refs, t("part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select("l_orderkey", "l_partkey")


@query("select user_id, min(event_id) as event_id from events where user_id not in (select user_id from events where event_type = 'signup' and value > 90) group by 1")
def first_visits(t):
    e = t("events")
    return state.first_visits(e, "user_id", "event_id", e.filter("event_type = 'signup' and value > 90")).select("user_id", "event_id")


@query("""
with r as (select l_orderkey as run, count(*) as observations, count(distinct l_suppkey) as u from lineitem group by 1)
select run, observations as search_observation_count, u as unique_vacancy_count, least(u, 3) as candidate_count, u > 3 as truncated from r""")
def discovery_counters(t):
    return report.discovery_counters(t("lineitem").withColumnRenamed("l_orderkey", "run"), ["run"], "l_suppkey", 3)


@query("""
select ts::date as run, count(*) as full_fetch_attempted, count(*) filter (event_type in ('view', 'click')) as full_fetched, sum((value)::bigint)::bigint as evaluation_candidate_count,
  count(*) filter (event_type = 'error') as failed, bool_or(event_type = 'error' and value > 99) as stopped_on_captcha from events group by 1""")
def observe_summary(t):
    s = F.expr("case when event_type in ('view', 'click') then 'fetched' when event_type = 'error' then 'failed' else 'rejected' end")
    e = t("events").select(F.to_date("ts").alias("run"), s.alias("status"), F.rint("value").cast("long").alias("items"), "event_type", "value")
    return report.observe_summary(e, ["run"], "status", "items", (F.col("event_type") == "error") & (F.col("value") > 99))


@query("""
with b as (select ts::date as run, count(*) filter (event_type in ('click', 'purchase')) as submitted, count(*) filter (event_type = 'purchase') as confirmed, count(*) filter (value > 40) as external_writes_attempted,
  count(*) filter (event_type = 'error') as failed from events group by 1)
select *, greatest(submitted, external_writes_attempted) as quota_consumed from b""")
def apply_summary(t):
    s = F.expr("case event_type when 'click' then 'submitted' when 'purchase' then 'confirmed' when 'error' then 'failed' else 'skipped' end")
    return report.apply_summary(t("events").select(F.to_date("ts").alias("run"), s.alias("status"), "value"), ["run"], "status", F.col("value") > 40)


@query("""
with r as (select o_orderkey, bool_or(l_returnflag = 'R') as loaded, bool_or(l_linestatus = 'F') as failed from orders left join lineitem on l_orderkey = o_orderkey group by 1),
f as (select o_orderstatus <> 'P' as eligible, o_orderpriority in ('1-URGENT', '2-HIGH') as selected, coalesce(loaded, false) as loaded, coalesce(failed, false) as failed from orders join r using (o_orderkey))
select count(*) as discovered, count(*) filter (eligible) as eligible, count(*) filter (eligible and not (loaded and not selected)) as pending, count(*) filter (selected) as selected,
  count(*) filter (selected and loaded) as loaded, count(*) filter (selected and failed) as failed from f""")
def load_report(t):
    li = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("l"), F.bool_or(F.col("l_linestatus") == "F").alias("f"))
    r = t("orders").join(li, "o_orderkey", "left")
    return report.load_report(r, F.col("o_orderstatus") != "P", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.coalesce("l", F.lit(False)), F.coalesce("f", F.lit(False)))


_OBJECTS = """select l_orderkey::varchar as run_id, l_shipdate::date as date, case l_returnflag when 'R' then 'summary' when 'A' then 'run_started' else 'account' end as name, l_partkey as vacancy_id,
  case l_linestatus when 'F' then 'vacancy' else 'search_item' end as object, l_orderkey || '/' || l_partkey || '/' || l_linestatus as key from lineitem"""


def _objects(t):
    return t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.to_date("l_shipdate").alias("date"), F.expr("case l_returnflag when 'R' then 'summary' when 'A' then 'run_started' else 'account' end").alias("run_name"), F.col("l_partkey").alias("vacancy_id"),
        F.when(F.col("l_linestatus") == "F", "vacancy").otherwise("search_item").alias("object"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), "l_linestatus").alias("key"))


@query(f"with o as ({_OBJECTS}) select run_id, min(date) as date, string_agg(distinct name, ',' order by name) as names, bool_or(name = 'summary') as has_summary, count(distinct date) > 1 as clash from o group by 1")
def run_discovery(t):
    r = raw.discover_runs(_objects(t).withColumns({"kind": F.lit("run"), "name": F.col("run_name")}))
    return r.select("run_id", "date", F.array_join("names", ",").alias("names"), "has_summary", "clash")


@query(f"with o as ({_OBJECTS}) select date, run_id, vacancy_id, min(key) filter (object = 'vacancy') as vacancy, min(key) filter (object = 'search_item') as search_item from o group by 1, 2, 3")
def candidate_objects(t):
    c = raw.candidate_keys(_objects(t).withColumns({"kind": F.lit("candidate"), "name": F.col("object")}))
    return c.select("date", "run_id", "vacancy_id", "vacancy", "search_item")


@query(f"with o as ({_OBJECTS}), r as (select run_id, min(date) as date from o group by 1) select run_id, date from r order by date, run_id limit 10")
def earliest_runs(t):
    return raw.select_runs(raw.discover_runs(_objects(t).withColumns({"kind": F.lit("run"), "name": F.col("run_name")})), limit=10).select("run_id", "date")


@query("""
with h as (select o_orderkey::varchar as run_id from orders where o_orderstatus = 'O'), r as (select l_orderkey::varchar as run_id, min(l_shipdate) as date, bool_or(l_returnflag = 'R') as s from lineitem group by 1)
select r.run_id from r join h using (run_id) where s""")
def eligible_runs(t):
    r = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("run_id")).agg(F.min("l_shipdate").alias("date"), F.bool_or(F.col("l_returnflag") == "R").alias("has_summary")).withColumn("clash", F.lit(False))
    h = t("orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "run_started").otherwise("other").alias("event_type"), F.lit(3).alias("schema_version"), F.lit("observe").alias("runtime_mode"))
    return raw.eligible_runs(r, h).select("run_id")


@query("select o_orderkey as id, o_orderdate, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def sync_postings(t):
    o = t("orders").withColumnRenamed("o_orderkey", "id")
    ids = t("customer").filter("c_acctbal < 0").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"))
    return raw.sync_postings(raw.read_index(o, ["id", "o_orderdate"], ("id",)), o, ids).select("id", "o_orderdate", "o_totalprice")


# --- accounts --------------------------------------------------------------


@query("""
select c_custkey, case when o.k is null then c_mktsegment else st end as c_mktsegment, coalesce(st = 'O', false) as enabled
from customer left join (select o_custkey as k, arg_max(o_orderstatus, o_orderkey) as st from orders group by 1) o on k = c_custkey""")
def attached_bindings(t):
    b = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("c_mktsegment")).withColumn("enabled", F.col("c_mktsegment") == "O")
    return reconcile.attach_bindings(t("customer").select("c_custkey", "c_mktsegment"), b, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "enabled")


@query("""
with b as (select s_nationkey, s_suppkey, c_mktsegment as s from supplier join (select distinct c_nationkey, c_mktsegment from customer where c_acctbal > 5000) on c_nationkey = s_nationkey where s_acctbal > 0),
f as (select s_nationkey, s, min(s_suppkey) as p from b group by 1, 2)
select n_nationkey, coalesce(string_agg(s, ',' order by p, s), '') as query_sets, (n_regionkey + 1) * 5 >= 12 as cap_reachable from nation left join f on s_nationkey = n_nationkey where n_regionkey > 0 group by n_nationkey, n_regionkey""")
def account_facts(t):
    sets = t("customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("query_sets"))
    b = t("supplier").join(sets, "s_nationkey").select(F.col("s_nationkey").alias("account_key"), F.col("s_suppkey").alias("binding_pos"), (F.col("s_acctbal") > 0).alias("enabled"), "query_sets")
    a = t("nation").select(F.col("n_nationkey").alias("account_key"), (F.col("n_regionkey") > 0).alias("enabled"), (F.col("n_regionkey") + 1).alias("apply_runs_per_day"), F.lit(5).alias("max_apply_per_run"), F.lit(12).alias("apply_daily_cap"))
    return accounts.account_facts(a, b).select(F.col("account_key").alias("n_nationkey"), F.array_join("query_sets", ",").alias("query_sets"), "cap_reachable")


@query("select p_brand, count(*) filter (p_size > 25) as enabled_queries, count(*) as queries from part group by 1")
def enabled_queries(t):
    return accounts.enabled_queries(t("part").withColumn("enabled", F.col("p_size") > 25), "p_brand")


@query("""
select sum(regexp_full_match(lower(c_mktsegment), '[a-z][a-z0-9_]*')::int)::bigint as accounts, sum(regexp_full_match(lower(c_name), '[a-z0-9][a-z0-9_.-]*')::int)::bigint as queries,
  sum(regexp_full_match(replace(lower(c_name), '#', '-'), '[a-z0-9][a-z0-9_.-]*')::int)::bigint as dashed, sum(regexp_full_match(c_mktsegment, '[a-z][a-z0-9_]*')::int)::bigint as sets from customer""")
def key_forms(t):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    n = lambda kind, c: F.count_if(accounts.key_sound(kind, c))
    return t("customer").agg(n("account", F.lower(seg)).alias("accounts"), n("query", F.lower(name)).alias("queries"), n("query", F.replace(F.lower(name), F.lit("#"), F.lit("-"))).alias("dashed"), n("query_set", seg).alias("sets"))


_RESUMES = "select c_custkey, c_nationkey, case when c_acctbal < 0 then timestamp '2024-02-01' end as inactive_at, coalesce(max(o_orderdate), timestamp '1990-01-01') as last_seen_at from customer left join orders on o_custkey = c_custkey group by c_custkey, c_nationkey, c_acctbal"


@query(f"""
with r as ({_RESUMES}), j as (select r.*, max(coalesce(inactive_at, last_seen_at)) over () as reconciled_at from r join nation on n_nationkey = c_nationkey where n_regionkey = 1)
select c_custkey as source_resume_id, c_nationkey as profile_key, reconciled_at from j""")
def resume_inventory(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("d"))
    r = t("customer").join(o, "c_custkey", "left").select(
        F.col("c_custkey").alias("source_resume_id"), F.col("c_nationkey").alias("profile_key"), F.when(F.col("c_acctbal") < 0, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("inactive_at"), F.coalesce("d", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")).alias("last_seen_at"))
    p = t("nation").select(F.col("n_nationkey").alias("profile_key"), F.col("n_regionkey").cast("string").alias("account_key"))
    return accounts.inventory(r, p, "1").select("source_resume_id", "profile_key", "reconciled_at")


@query("select o_orderkey from orders join customer on c_custkey = o_custkey where c_acctbal >= 0 and c_mktsegment <> 'BUILDING'")
def claimable_requests(t):
    c = t("customer").select(F.col("c_nationkey").alias("profile_key"), F.col("c_custkey").alias("source_resume_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("deleted").alias("lifecycle"), (F.col("c_mktsegment") != "BUILDING").alias("present"))
    q = t("orders").join(c.select("source_resume_id", "profile_key"), F.col("source_resume_id") == F.col("o_custkey")).select("o_orderkey", "profile_key", "source_resume_id")
    return accounts.claimable(q, c).select("o_orderkey")


@query("""
select o_orderkey, n_nationkey * 10 as profile_row, c_custkey + 7 as resume_row, v.r as vacancy_row from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey and n_regionkey < 3
join (select l_orderkey, max(l_linenumber) as r from lineitem where l_returnflag = 'R' group by 1) v on v.l_orderkey = o_orderkey""")
def application_identities(t):
    c = t("customer").select(F.col("c_nationkey").alias("profile_key"), F.col("c_custkey").alias("source_resume_id"), (F.col("c_custkey") + 7).alias("resume_row"))
    a = t("orders").join(c.drop("resume_row"), F.col("source_resume_id") == F.col("o_custkey")).select(F.lit("board").alias("source"), "profile_key", "source_resume_id", F.col("o_orderkey").alias("vacancy_id"))
    p = t("nation").filter("n_regionkey < 3").select(F.lit("board").alias("source"), F.col("n_nationkey").alias("profile_key"), (F.col("n_nationkey") * 10).alias("profile_row"))
    v = t("lineitem").filter("l_returnflag = 'R'").groupBy(F.lit("board").alias("source"), F.col("l_orderkey").alias("source_entity_id")).agg(F.max("l_linenumber").alias("vacancy_row"))
    return accounts.identities(a, p, c, v).select(F.col("vacancy_id").alias("o_orderkey"), "profile_row", "resume_row", "vacancy_row")


@query("""
select o_orderkey, o_orderstatus from orders join customer on c_custkey = o_custkey where date_diff('second', o_orderdate, timestamp '2001-09-01') <= 700 * 86400 and o_orderstatus <> 'F' and o_orderstatus = 'O'
  and c_nationkey not in (select s_nationkey from supplier where s_acctbal > 9500)""")
def reply_queue(t):
    n = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "o_orderstatus", F.col("o_custkey").alias("resume_id"), F.col("o_orderdate").alias("updated_at"), F.expr("case o_orderstatus when 'F' then 'discard' when 'O' then 'invitation' else 'response' end").alias("state"), F.col("c_nationkey").alias("employer_id"))
    bad = t("supplier").filter("s_acctbal > 9500").select(F.col("s_nationkey").alias("employer_id"))
    return accounts.reply_queue(n, bad, F.lit("2001-09-01 00:00:00").cast("timestamp"), 700, True).select("o_orderkey", "o_orderstatus")


@query("""
select 'stays' as part, event_type, count(*) as n from events where event_type <> 'error' group by 2 union all select 'goes', 'error', count(*) from events where event_type = 'error'""")
def purge_skipped(t):
    stay, gone = accounts.purge_skipped(t("events").withColumn("reason", F.col("event_type")), "error")
    return stay.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit("stays").alias("part"), "event_type", "n").unionByName(gone.select(F.lit("goes").alias("part"), F.lit("error").alias("event_type"), F.col("purged").alias("n")))


@query("select l_orderkey, count(*) as items, count(distinct l_partkey) as distinct_items, count(*) = count(distinct l_partkey) as sound from lineitem group by 1")
def sound_snapshot(t):
    return reconcile.sound_snapshot(t("lineitem"), ["l_orderkey"], "l_partkey")


@query("""
select c_nationkey, coalesce(string_agg(c_custkey::varchar, ',' order by c_custkey) filter (c_acctbal >= 9000), '') as registered, coalesce(string_agg(c_custkey::varchar, ',' order by c_custkey) filter (c_acctbal < 0), '') as deleted, count(*)::int as resumes
from customer group by 1""")
def reconcile_audit(t):
    kind = F.when(F.col("c_acctbal") >= 9000, "registered").when(F.col("c_acctbal") < 0, "deleted").otherwise("unchanged")
    a = mapping.reconcile_audit(t("customer").withColumn("change", kind), ["c_nationkey"], "c_custkey", "change", ["c_mktsegment"])
    return a.select("c_nationkey", F.array_join("registered_ids", ",").alias("registered"), F.array_join("deleted_ids", ",").alias("deleted"), F.size("resumes").alias("resumes"))


# --- rules -----------------------------------------------------------------


@query(f"with {_TAGGED}, decided as (select *, {_demo_decision('t')} from tagged) select case when reason = 'accepted' and coalesce(toxic, 0) = 1 then 'archived' else reason end as reason, lang, count(*) as n from decided left join labels using (doc_id) group by 1, 2")
def search_gate(t):
    d = _titled(t("documents")).join(t("labels"), "doc_id", "left")
    return rules.search_gate(d, "title", F.col("toxic") == 1, DEMO).groupBy(F.col("decision.reason").alias("reason"), "lang").agg(F.count("*").alias("n"))


@query("select doc_id, sha256(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || coalesce(text, '')) as context_hash from documents")
def full_context(t):
    return t("documents").select("doc_id", T.sha256(rules.full_context(F.col("source"), F.col("lang"), F.col("text"))).alias("context_hash"))


@query(r"select lang, source, count(*) as n from documents where regexp_matches(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || regexp_replace(regexp_replace(coalesce(text, ''), '<br\s*/?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '(?i)license|idiot|web|wiki') group by 1, 2")
def excluded_by_pattern(t):
    return t("documents").filter(rules.excluded_by_pattern(F.col("source"), F.col("lang"), F.col("text"), "license|idiot|web|wiki")).groupBy("lang", "source").agg(F.count("*").alias("n"))


_APPLY = """select o_orderkey, case when o_orderstatus = 'F' then 'relations' when c_acctbal < 0 then 'archived' when c_mktsegment = 'BUILDING' then 'has_test' when o_orderpriority = '5-LOW' then 'redirect' end as reason,
  coalesce(o_orderstatus = 'F' and o_totalprice > 200000, false) as rejected from orders join customer on c_custkey = o_custkey"""


@query(f"with a as ({_APPLY}) select reason is null as eligible, reason, rejected, count(*) as n from a group by 1, 2, 3")
def apply_eligibility(t):
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    relations = F.when(F.col("o_orderstatus") == "F", F.array(F.when(F.col("o_totalprice") > 200000, "got_rejection").otherwise("got_response")))
    url = F.when(F.col("o_orderpriority") == "5-LOW", "https://elsewhere.example")
    d = j.select(rules.apply_eligibility(relations, F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING", url, True).alias("d"))
    return d.groupBy("d.eligible", "d.reason", "d.rejected").agg(F.count("*").alias("n"))


@query("""
select array_to_string(list_filter([case when o_custkey is distinct from c_custkey or l_partkey % 10 = 3 then 'id_mismatch' end, case when o_orderstatus = 'F' then 'archived' end, case when c_acctbal < 0 then 'closed_for_applicants' end,
  case when o_orderpriority = '5-LOW' then 'external_response_url' end], lambda x: x is not null), ',') as blockers, case when c_mktsegment = 'BUILDING' then 'upstream_hh_test' else 'negotiations_api' end as mode, count(*) as n
from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by 1, 2""")
def submission_blockers(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    b = rules.submission_blockers(F.col("o_custkey"), F.when(F.col("l_partkey") % 10 != 3, F.col("c_custkey")), F.col("o_orderstatus") == "F", F.col("c_acctbal") < 0, F.when(F.col("o_orderpriority") == "5-LOW", "u"))
    return j.groupBy(F.array_join(b, ",").alias("blockers"), mapping.submission_mode(F.col("c_mktsegment") == "BUILDING").alias("mode")).agg(F.count("*").alias("n"))


# --- merges ----------------------------------------------------------------


@query("""
with e as (select user_id, ts, event_id, case when event_type <> 'view' then value end as v, props, event_type = 'purchase' as is_full from events)
select user_id, arg_max(v, (ts, event_id)) filter (is_full or v is not null) as value, arg_max(props, (ts, event_id)) as raw_uri, min(ts) as first_seen, max(ts) as last_seen from e group by 1""")
def event_time_merge(t):
    e = t("events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.col("props").alias("raw_uri"), (F.col("event_type") == "purchase").alias("is_full"))
    partial, full = e.filter("not is_full").drop("is_full"), e.filter("is_full")
    feed = merge.change_feed(partial, full).withColumn("is_full", F.coalesce("is_full", F.lit(False)))
    return merge.coalesce_merge(feed, ["user_id"], "ts", "event_id", ["value"], ["raw_uri"], [], "is_full", {"first_seen": "ts"}, {"last_seen": "ts"}, mode="event_time")


@query("select o_custkey, arg_max(o_orderstatus, o_orderkey) as status, arg_max(o_orderpriority, o_orderkey) as priority, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen from orders where o_orderstatus <> 'F' group by 1")
def reconciled_resumes(t):
    o = merge.applications_from(t("orders"), "o_orderstatus", "F").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"))
    return merge.reconciled_merge(o, ["o_custkey"], ["o_orderkey"], "first_seen", "last_seen").select("o_custkey", "status", "priority", "first_seen", "last_seen")


@query("""
with bad as (select distinct l_orderkey from lineitem where l_quantity > 49), good as (select l_orderkey, l_linenumber, l_partkey, 'new' as v from lineitem where l_returnflag = 'R' and l_orderkey not in (select l_orderkey from bad)),
kept as (select l_orderkey, l_linenumber, l_partkey, 'old' as v from lineitem where l_returnflag <> 'R' and l_orderkey not in (select l_orderkey from good))
select * from good union all select * from kept""")
def replayed_runs(t):
    li = t("lineitem")
    li = spread(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"), ["l_orderkey"], li.count())
    loaded = merge.whole_runs(li.filter("l_returnflag = 'R'"), li.filter("l_quantity > 49"), ["l_orderkey"])
    mark = lambda df, v: df.select("l_orderkey", "l_linenumber", "l_partkey", F.lit(v).alias("v"))
    return merge.replace_runs(mark(li.filter("l_returnflag <> 'R'"), "old"), mark(loaded, "new"), ["l_orderkey"])


# --- quality ---------------------------------------------------------------


@query("""
with r as (select case when o_totalprice < 0 then 'price' end as a, case when o_orderstatus not in ('F', 'O') then 'status' end as b, case when o_orderpriority is null or o_orderpriority = '5-LOW' then 'priority' end as c, o_orderkey from orders)
select o_orderkey, unnest(list_filter([a, b, c], lambda x: x is not null)) as rule from r""")
def quarantined_orders(t):
    return quality.quarantine(t("orders"), {"price": F.col("o_totalprice") >= 0, "status": F.col("o_orderstatus").isin("F", "O"), "priority": F.col("o_orderpriority") != "5-LOW"}, ["o_orderkey"])


@query("""
with j as (select l_shipdate, o_orderdate, o_orderstatus, l_linestatus, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_quantity from lineitem join orders on o_orderkey = l_orderkey),
s as (select case o_orderstatus when 'F' then 'finished' when 'O' then 'running' else 'other' end as st, case when l_linestatus = 'F' then l_shipdate end as fin, * from j)
select sum((not (st in ('running', 'incomplete', 'finished') and coalesce(fin >= o_orderdate, true) and (st <> 'finished' or fin is not null)))::int)::bigint as run,
  sum((not (l_linenumber - 1 >= 1 and l_shipdate >= o_orderdate and l_returnflag in ('A', 'N')))::int)::bigint as claim,
  sum((l_partkey is distinct from l_suppkey)::int)::bigint as payload,
  sum((not (o_orderstatus <> 'F' or l_linestatus = 'F'))::int)::bigint as implied,
  sum((not (l_linestatus = 'F' or l_shipdate is null))::int)::bigint as lifecycle,
  sum((not (l_quantity::int >= 1 and l_linenumber between 0 and l_quantity::int - 1 and (l_linenumber + 3) % l_quantity::int between 0 and l_quantity::int - 1 and 3 between 1 and l_quantity::int))::int)::bigint as rotation,
  count(*) as rows from s""")
def rule_table(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    st, fin = F.expr("case o_orderstatus when 'F' then 'finished' when 'O' then 'running' else 'other' end"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))
    claim = F.expr("case l_returnflag when 'A' then 'CLAIMED' when 'N' then 'SUBMITTED' else 'LOST' end")
    size, at = F.rint("l_quantity").cast("int"), F.col("l_linenumber")
    there = F.col("l_linestatus") == "F"
    v = quality.violations(j, {
        "run": quality.run_sound(st, F.col("o_orderdate"), fin), "claim": quality.claim_sound(claim, at - 1, F.col("o_orderdate"), F.col("l_shipdate"), F.col("l_shipdate"), F.lit(None).cast("timestamp")),
        "payload": quality.payload_id_sound(F.col("l_partkey"), F.col("l_suppkey")), "implied": quality.implies(F.col("o_orderstatus") == "F", there),
        "lifecycle": quality.lifecycle_sound(F.when(there, "active").otherwise("deleted"), there, F.when(~there, _none())),
        "rotation": quality.rotation_sound(size, at, F.pmod(at + 3, size), F.lit(3), at + 3 >= size)})
    return v.groupBy("rows").pivot("rule", ["run", "claim", "payload", "implied", "lifecycle", "rotation"]).agg(F.first("violations"))


@query("select doc_id, regexp_full_match(sha256(text), '[0-9a-f]{64}') as digest, regexp_full_match(text, '[0-9a-f]{64}') as plain from documents where text is not null")
def digest_forms(t):
    return t("documents").filter("text is not null").select("doc_id", quality.hex64(T.sha256(F.col("text"))).alias("digest"), quality.hex64(F.col("text")).alias("plain"))


# --- fields and texts ------------------------------------------------------


@query("""
select c_custkey, case when length(c_name) > 12 then substr(c_name, 1, 11) || '…' else c_name end as short, 'https://' || lower(c_mktsegment) || '.example' as url, case when c_acctbal > 0 then 'true' else 'false' end as flag,
  lpad((c_nationkey % 12 + 1)::varchar, 2, '0') as month, '7' as country, lpad((c_custkey % 1000)::varchar, 3, '0') as city, (c_custkey + 1000000)::varchar as number, abs(c_acctbal)::bigint as amount, 'USD' as currency,
  c_mktsegment || ', ' || c_name as listed, c_nationkey % 3 = 0 as captcha from customer""")
def field_forms(t):
    c = t("customer")
    month = T.month_date(F.concat((F.col("c_nationkey") % 12 + 1).cast("string"), F.lit(".2020")))
    phone = T.phone_parts(F.concat(F.lit("8 ("), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(") "), (F.col("c_custkey") + 1000000).cast("string")))
    money = T.amount(F.concat(F.lit("from "), F.rint(F.abs("c_acctbal")).cast("long").cast("string"), F.lit(" $ a month")), {"$": "USD", "€": "EUR"})
    return c.select(
        "c_custkey", T.shorten(F.col("c_name"), 12).alias("short"), T.with_scheme(F.concat(F.lower("c_mktsegment"), F.lit(".example"))).alias("url"), T.flag_text(F.col("c_acctbal") > 0).alias("flag"), F.substring(month, 6, 2).alias("month"),
        phone["country"].alias("country"), phone["city"].alias("city"), phone["number"].alias("number"), money["amount"].alias("amount"), money["currency"].alias("currency"), T.list_text(F.array("c_mktsegment", "c_name")).alias("listed"),
        T.has_captcha(F.when(F.col("c_nationkey") % 3 == 0, "CAPTCHA required").otherwise("none")).alias("captcha"))


@query(r"""
select page_id, sha256(trim(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), ' ')) as stripped from pages""")
def stripped_pages(t):
    return t("pages").select("page_id", T.sha256(T.strip_tags(F.col("html"))).alias("stripped"))


@query("""
select event_id, case event_type when 'view' then true when 'click' then false when 'purchase' then true when 'error' then false end as verdict,
  case when event_type = 'signup' then 'later' else strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') end as shown, 'a' || chr(10) || event_type || chr(9) || chr(92) as unescaped from events""")
def answer_forms(t):
    e = F.col("event_type")
    answer = F.when(e == "view", " Yes ").when(e == "click", "нет").when(e == "purchase", 'well: {"suitable": true, "n": 1}').when(e == "error", '{"suitable": false}').otherwise("perhaps")
    when = F.when(e == "signup", "later").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0000'"))
    return t("events").select("event_id", T.verdict(answer).alias("verdict"), T.api_time_text(when).alias("shown"), T.unescape(F.concat(F.lit(r"a\n"), e, F.lit(r"\t\\"))).alias("unescaped"))


@query("""
select o_orderkey::varchar as source_entity_id, o_orderpriority as title, c_name as company_name, c_mktsegment as area_name, coalesce(o_orderstatus = 'F', false) as archived, o_orderstatus = 'P' as has_test, (o_totalprice > 200000)::int as relations from orders join customer on c_custkey = o_custkey""")
def search_items(t):
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit(" "), "o_orderpriority").alias("name"), F.struct(F.col("c_name").alias("name")).alias("employer"), F.struct(F.col("c_mktsegment").alias("name")).alias("area"),
        F.when(F.col("o_totalprice") > 200000, F.array(F.lit("got_response"))).alias("relations"), (F.col("o_orderstatus") == "F").alias("archived"), F.when(F.col("o_orderstatus") == "P", True).alias("has_test")).alias("v"))
    flags = mapping.operational_flags(j, "v")
    return mapping.search_item(j.withColumn("flags", flags), "v", ["flags"]).select("source_entity_id", "title", "company_name", "area_name", "flags.archived", "flags.has_test", F.size("flags.relations").alias("relations"))


@query("""
select o_orderkey::varchar as id, coalesce(nullif(l, 0), nullif(h, 0), 0)::bigint as salary_from, coalesce(nullif(h, 0), nullif(l, 0), 0)::bigint as salary_to, case when o_orderstatus = 'P' then 'EUR' else 'RUR' end as currency, o_orderpriority = '1-URGENT' as remote
from (select *, case when o_orderstatus = 'F' then 0 else o_custkey end as l, case when o_orderstatus = 'O' then null else o_orderkey end as h from orders)""")
def posting_rows(t):
    money = F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.col("o_custkey")).alias("from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")).alias("to"), F.when(F.col("o_orderstatus") == "P", "EUR").alias("currency"))
    j = t("orders").select(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("n").alias("name"), money.alias("salary"), F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "remote").alias("id")).alias("schedule")).alias("v"))
    return mapping.posting_row(j, "v").select("id", "salary_from", "salary_to", "currency", "remote")


@query("""
select p_partkey, p_name, coalesce(p_size, 0) as size, case when p_size > 25 then null else p_partkey end as number, (p_size > 25)::int as cast_failures, case when p_size > 25 then 'many' end as kept, '{"a":"' || p_brand || '","b":' || p_size || '}' as doc from part""")
def mapped_fields(t):
    p = t("part").select(F.struct("p_partkey", F.struct(F.col("p_name").alias("name")).alias("inner"), "p_size", F.when(F.col("p_size") > 25, "many").otherwise(F.col("p_partkey").cast("string")).alias("n"), F.struct(F.col("p_brand").alias("a"), F.col("p_size").alias("b")).alias("d")).alias("v"))
    m = mapping.mapped(p, {"p_partkey": ("p_partkey", "bigint", None), "p_name": ("inner.name", "string", None), "size": ("p_size", "int", 0), "number": ("n", "bigint", None), "doc": ("d", "json", None)}, "v")
    return m.select("p_partkey", "p_name", "size", "number", "cast_failures", F.element_at("uncast", "number").alias("kept"), "doc")


@query("""
select c_custkey, 'Mr ' || c_name || chr(10) || 'a, b' || chr(10) || c_mktsegment || ': ' || c_nationkey as context, c_name || chr(10) || c_mktsegment as posting, case when c_acctbal > 0 then '+7 1, +7 2' else '+7 1' end as phones,
  case when c_nationkey = 0 then 10 else c_nationkey end::bigint as per_page, case when c_acctbal > 0 then 'published' else 'hidden' end as status from customer""")
def contexts(t):
    past = F.array(F.struct(F.col("c_mktsegment").alias("company"), F.col("c_nationkey").cast("string").alias("position")))
    phones = F.array(F.struct(F.lit(1).alias("number"), F.lit("+7 1").alias("formatted")), F.struct(F.when(F.col("c_acctbal") > 0, 2).alias("number"), F.lit("+7 2").alias("formatted")))
    status = F.when(F.col("c_acctbal") > 0, '{"id":"published"}').otherwise('"hidden"')
    return t("customer").select(
        "c_custkey", mapping.resume_context(mapping.resume_title(_none(), F.concat(F.lit("Mr "), "c_name")), F.array(F.lit("a"), F.lit("b")), past).alias("context"),
        mapping.posting_context(F.col("c_name"), F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>")), F.array(F.lit("x"))).alias("posting"), mapping.phones(phones).alias("phones"),
        mapping.effective(F.col("c_nationkey").cast("long"), F.lit(10).cast("long")).alias("per_page"), mapping.upstream_status(status).alias("status"))


@query("select o_custkey as parent_o_custkey, o_orderkey, o_orderstatus from orders")
def flattened_children(t):
    o = t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("children"))
    return mapping.flatten_children(o, ["o_custkey"], "children")


@query("select event_id, '{\"relations\":[\"' || event_type || '\"],\"value\":\"' || user_id || '\"}' as metadata, coalesce(props::json ->> '$.k', '') as kept from events")
def evidence_parts(t):
    kept = mapping.keep_keys(F.col("props"), ["k", "other"])
    return t("events").select("event_id", mapping.evidence_metadata(F.array("event_type"), value=F.col("user_id").cast("string"), absent=_none()).alias("metadata"), F.coalesce(F.element_at(kept, "k"), F.lit("")).alias("kept"))


@query("""
with d as (select o_orderpriority, date_diff('day', o_orderdate::date, l_shipdate::date) as days from lineitem join orders on o_orderkey = l_orderkey),
r as (select *, row_number() over (partition by o_orderpriority order by days) as k, count(*) over (partition by o_orderpriority) as n from d)
select o_orderpriority, max(n) as n, min(days) filter (k >= ceil(0.5 * n))::int as p50, min(days) filter (k >= ceil(0.9 * n))::int as p90 from r group by 1""")
def latency_days(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return report.latency(j, ["o_orderpriority"], "o_orderdate", "l_shipdate", [0.5, 0.9])


@query("""
with d as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by 1, 2), j as (select o_custkey, l_returnflag, sum(n)::bigint as n from d join orders on o_orderkey = l_orderkey group by 1, 2)
select o_custkey, string_agg(l_returnflag || '=' || n, ',' order by l_returnflag) as reasons from j group by 1""")
def merged_reasons(t):
    h = report.histogram(t("lineitem"), ["l_orderkey"], "l_returnflag").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    m = report.merge_maps(h, ["o_custkey"], "reasons")
    return m.select("o_custkey", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("reasons"))
