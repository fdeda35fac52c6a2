"""Registered queries of the job-data operators on the driver's tables, each with its DuckDB SQL.

The tables stand in for postings, résumés, runs and accounts; every query reads
its whole tables.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmill.functions import lexicons as L
from jobmill.functions import text as T
from jobmill.operators import merge, quality, reconcile, report, routing, rules, state
from jobmill.operators.spread import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


# --- rules -----------------------------------------------------------------


def _word(*words: str) -> str:
    return rf"(^|[^\pL\pN_])({'|'.join(words)})([^\pL\pN_]|$)"


#: Stands in for the posting lexicons: words of the invented prose.
DEMO = L.Rules(
    {"article": _word("the", "le", "der", "el"), "link": _word("and", "et", "und", "y"), "place": _word("in", "en", "on")},
    {"query": _word("was", "que"), "idiom": _word("idiot", "moron", "scum")},
    {"maker": _word("her", "qui", "ist"), "copy": _word("copyright", "license")},
    ("with", _word("with", "avec", "mit"), "link"),
    ("place", _word("ing", "ion", "ed"), "place_alone"),
)

_DEMO_TAGS = ", ".join(
    f"list_filter([{', '.join(f'''case when regexp_matches(%s, '(?i){p}') then '{t}' end''' for t, p in lex.items())}], lambda x: x is not null) as {name}"
    for name, lex in (("d", DEMO.domains), ("c", DEMO.contexts), ("r", DEMO.roles))
)


def _demo_decision(title: str) -> str:
    return f"""
      case when t = '' then 'missing_title' when len(d) = 0 then 'title_out_of_scope' when len(c) > 0 then 'excluded_context'
        when len(r) > 0 then 'title_contains_unrelated_role'
        when regexp_matches({title}, '(?i){DEMO.unless[1]}') and not list_contains(d, 'link') then 'with_without_link'
        when d = ['place'] and not regexp_matches({title}, '(?i){DEMO.alone[1]}') then 'place_alone' else 'accepted' end as reason,
      case when t = '' or len(d) = 0 then '' when len(c) > 0 then array_to_string(c, ',') when len(r) > 0 then array_to_string(r, ',')
        when regexp_matches({title}, '(?i){DEMO.unless[1]}') and not list_contains(d, 'link') then 'with' else '' end as blocked"""


_TITLES = "select doc_id, lang, text, trim(split_part(text, chr(10), 1)) as t from documents"
_TAGGED = f"tagged as (select *, {_DEMO_TAGS.replace('%s', 't')} from ({_TITLES}))"


def _titled(docs: DataFrame) -> DataFrame:
    return docs.withColumn("title", F.split("text", "\n")[0])


@query(f"with {_TAGGED}, decided as (select *, {_demo_decision('t')} from tagged) select reason, blocked, lang, count(*) as n from decided group by 1, 2, 3")
def rule_decision_report(t):
    d = rules.title_decision(_titled(t("documents")), "title", DEMO)
    return d.groupBy(F.col("decision.reason").alias("reason"), F.array_join("decision.blocked_terms", ",").alias("blocked"), "lang").agg(F.count("*").alias("n"))


_GATED = f"""
with {_TAGGED}, decided as (select *, {_demo_decision('t')} from tagged),
full_text as (select decided.*, list_filter([{', '.join(f"case when regexp_matches(text, '(?i){p}') then '{k}' end" for k, p in DEMO.contexts.items())}], lambda x: x is not null) as fc,
  coalesce(l.toxic, 0) = 1 as archived, coalesce(l.quality, 1) = 0 as closed, doc_id % 3 + 1 as area
  from decided left join labels l using (doc_id)),
gated as (select doc_id, lang, case when reason <> 'accepted' then reason when len(fc) > 0 then 'excluded_context' when archived then 'archived' when closed then 'closed_for_applicants'
    when area <> 1 then 'area_' || area || '_not_allowed' else 'accepted' end as reason, reason as first_reason from full_text)"""


def _gate(t, searched: bool = False) -> DataFrame:
    d = _titled(t("documents"))
    d = (rules.title_decision(d, "title", DEMO, "searched") if searched else d).join(t("labels"), "doc_id", "left")
    return rules.full_gate(d, "title", F.col("text"), F.col("toxic") == 1, F.col("quality") == 0, F.lit(None).cast("string"), rules.area_id((F.col("doc_id") % 3 + 1).cast("string")), 1, DEMO)


@query(f"{_GATED} select lang, reason, count(*) as n from gated group by 1, 2")
def rule_full_gate(t):
    return _gate(t).groupBy("lang", F.col("decision.reason").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{_GATED},
log as (select 'prefilter' as stage, 'prefilter_' || first_reason as reason, false as accepted from gated where first_reason <> 'accepted'
  union all select 'full_validation', reason, reason = 'accepted' from gated where first_reason = 'accepted')
select stage, reason, accepted, count(*) as n from log group by 1, 2, 3""")
def two_stage_log(t):
    return rules.two_stage_log(_gate(t, searched=True), ["doc_id"]).groupBy("stage", "reason", "accepted").agg(F.count("*").alias("n"))


# --- routing ---------------------------------------------------------------


@query("""
with f as (select user_id, event_type, min(event_id) as p from events group by 1, 2)
select user_id, string_agg(event_type, ',' order by p) as query_keys, min(p) as first_pos,
  (select count(*) from events e where e.user_id = f.user_id) as observations,
  (select props from events e where e.event_id = min(p)) as item from f group by user_id""")
def search_union_dedup(t):
    u = routing.union_candidates(t("events"), ["user_id"], "event_id", ["props"], {"keys": "event_type"})
    return u.select("user_id", F.array_join("keys", ",").alias("query_keys"), "first_pos", "observations", F.col("props").alias("item"))


@query("""
with r as (select ts::date as run, event_id, row_number() over w as rk,
    coalesce(max(event_type = 'error') over (partition by ts::date order by event_id rows between unbounded preceding and 1 preceding), false) as paused
  from events window w as (partition by ts::date order by event_id))
select run, case when rk > 60 then 'beyond_unique' when paused then 'account_paused' when rk > 25 then 'technical_limit' else 'attempted' end as status,
  count(*) as n, max(rk)::int as last_rank from r group by 1, 2""")
def discovery_caps(t):
    e = t("events").select(F.to_date("ts").alias("run"), "event_id", (F.col("event_type") == "error").alias("stop"))
    return routing.technical_caps(e, ["run"], "event_id", 60, 25, "stop").groupBy("run", "status").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


@query("""
with c as (select p_partkey, p_name, p_partkey as pos from part)
select p_partkey, p_name, (pos - (n - 10) + n) % n as place from c, (select count(*) as n from part) where (pos - (n - 10) + n) % n < 25""")
def query_window(t):
    n = F.col("n")  # of the whole catalogue, one row; the window starts ten before its end and goes round
    c = t("part").withColumn("pos", F.col("p_partkey")).join(F.broadcast(t("part").agg(F.count("*").alias("n"))))
    return routing.circular_window(c, "pos", n, n - 10, 25).select("p_partkey", "p_name", "place")


_SETS = "['MACHINERY', 'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD']"


@query(f"""
select n_name, count(*) as items, sum(has::int)::bigint as overlapping, sum(keys)::bigint as shared_keys from (
  select n_name, c_mktsegment = any_set as has, (c_mktsegment = any_set)::int as keys
  from (select s_nationkey, {_SETS}[(s_suppkey % 5 + 1)::int] as any_set from supplier) join customer on c_nationkey = s_nationkey join nation on n_nationkey = c_nationkey
) group by n_name""")
def fanout_work_items(t):
    sets = F.array(*map(F.lit, ("MACHINERY", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")))
    v = t("customer").select("c_custkey", F.col("c_nationkey").alias("account"), F.array("c_mktsegment").alias("matched_sets"), F.array(F.lit("q")).alias("matched_keys"), F.create_map(F.lit("q"), "c_mktsegment").alias("key_sets"))
    b = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("account"), F.array(F.element_at(sets, (F.col("s_suppkey") % 5 + 1).cast("int"))).alias("resume_sets"))
    w = routing.fan_out_counts(v, b, ["account"], "matched_keys", "matched_sets", "key_sets", "resume_sets")
    n = t("nation").select(F.col("n_nationkey").alias("account"), "n_name")
    return w.join(n, "account").drop("account")


@query("""
with e as (select s_nationkey as nation, s_suppkey as m from supplier), a as (select n_nationkey as nation, l_suppkey as m, count(*) as k from lineitem join nation on n_nationkey = l_partkey % 25 group by 1, 2),
j as (select coalesce(e.nation, a.nation) as nation, e.m as em, a.m as am, k from e full join a on e.nation = a.nation and e.m = a.m)
select nation, sum((am is null)::int)::bigint as missing, sum((em is null)::int)::bigint as unexpected, coalesce(sum((k > 1)::int), 0)::bigint as repeated,
  sum((am is null)::int) + sum((em is null)::int) + coalesce(sum((k > 1)::int), 0) = 0 as complete from j group by nation""")
def fanout_completeness(t):
    s = t("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("m"))
    a = t("lineitem").select(F.col("l_suppkey").alias("m"), (F.col("l_partkey") % 25).cast("int").alias("nation")).join(t("nation").select(F.col("n_nationkey").alias("nation")), "nation")
    return routing.fan_out_completeness(s, a, ["nation"], "m")


@query("""
select l_orderkey, count(distinct l_linenumber) as seen, max(l_linenumber) - 1 as last_page, max(l_linenumber) as declared,
  count(distinct l_linenumber) >= max(l_linenumber) as complete from lineitem group by 1""")
def page_completeness(t):
    top = Window.partitionBy("l_orderkey")
    li = t("lineitem")
    p = spread(li.select("l_orderkey", "l_linenumber"), ["l_orderkey"], li.count()).select("l_orderkey", (F.col("l_linenumber") - 1).alias("page"), F.max("l_linenumber").over(top).alias("pages"))
    return routing.page_completeness(p, ["l_orderkey"], "page", "pages")


@query("""
with w as (select distinct l_orderkey, l_partkey from lineitem where l_returnflag = 'R')
select w.l_orderkey, w.l_partkey, string_agg(l_linenumber || ':' || l_linestatus, ',' order by l_linenumber, l_linestatus) as matches, count(l_linenumber) > 0 as found
from w left join (select * from lineitem where l_returnflag <> 'R') l on l.l_orderkey = w.l_orderkey and l.l_partkey = w.l_partkey group by 1, 2""")
def negotiation_evidence(t):
    li = t("lineitem")
    # returned lines ask, all others are the pages
    e = routing.negotiation_evidence(li.filter("l_returnflag <> 'R'"), li.filter("l_returnflag = 'R'"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_linestatus"])
    shown = F.transform("matches", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_linestatus"]))
    return e.select("l_orderkey", "l_partkey", F.when(F.col("found"), F.array_join(shown, ",")).alias("matches"), "found")


@query("""
with v as (select p_partkey, p_brand, i as pos, string_split(p_name, ' ')[i] as s from part, range(1, 4) r(i) where i <= len(string_split(p_name, ' '))),
n as (select p_partkey, p_brand, min(pos) as pos, arg_min(s, pos) as s, regexp_replace(lower(s), '[^a-zа-яё0-9+#.]+', '', 'g') as f from v group by p_partkey, p_brand, f),
r as (select distinct p_brand, regexp_replace(lower(string_split(p_type, ' ')[1]), '[^a-zа-яё0-9+#.]+', '', 'g') as f from part
      union select distinct p_brand, regexp_replace(lower(string_split(p_name, ' ')[1]), '[^a-zа-яё0-9+#.]+', '', 'g') from part where p_size > 40)
select p_partkey, p_brand, array_to_string(list(s order by pos)[1:3], ',') as skills from n join r using (p_brand, f) where f <> '' group by 1, 2""")
def skill_overlap_top3(t):
    p = t("part")
    v = p.select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("pos", "skill"))
    r = p.select("p_brand", F.split("p_type", " ")[0].alias("skill")).union(p.filter("p_size > 40").select("p_brand", F.split("p_name", " ")[0])).withColumn("pos", F.lit(0))
    m = routing.matched_skills(v, r, ["p_partkey", "p_brand"], ["p_brand"], "skill", "pos", T.skill_form)
    return m.select("p_partkey", "p_brand", F.array_join("skills", ",").alias("skills"))


@query("""
with refs as (select s_nationkey as k, min(s_suppkey) as set_pos from supplier group by 1)
select c_nationkey as query_set_key, set_pos, c_custkey as query_pos, c_name from customer join refs on k = c_nationkey where c_acctbal > 0""")
def ordered_union(t):
    refs = t("supplier").select(F.col("s_nationkey").alias("query_set_key"), F.col("s_suppkey").alias("set_pos"))
    q = t("customer").select(F.col("c_nationkey").alias("query_set_key"), F.col("c_custkey").alias("query_pos"), "c_name", (F.col("c_acctbal") > 0).alias("enabled"))
    return routing.ordered_union(refs, q).select("query_set_key", "set_pos", "query_pos", "c_name")


@query("""
with s as (select user_id, list(distinct event_type order by event_type) as all_types, list(distinct event_type order by event_type) filter (value > 50) as high from events group by 1)
select user_id, len(list_filter(coalesce(high, []), lambda x: not list_contains(all_types, x))) = 0 as is_subset, coalesce(high, []) = all_types as is_equal,
  list_has_any(coalesce(high, []), ['error', 'signup']) as overlaps from s""")
def set_rules(t):
    s = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("h"))
    return s.select("user_id", routing.subset(F.col("h"), F.col("a")).alias("is_subset"), routing.same_set(F.col("h"), F.col("a")).alias("is_equal"), F.arrays_overlap("h", F.array(F.lit("error"), F.lit("signup"))).alias("overlaps"))


# --- merges ----------------------------------------------------------------


@query("select user_id, ts, event_id as seq, event_type, value, props from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_full_state(t):
    return merge.newest(t("events").withColumnRenamed("event_id", "seq"), ["user_id"], ["ts", "seq"]).select("user_id", "ts", "seq", "event_type", "value", "props")


@query("""
with e as (select *, event_type <> 'purchase' as partial, ts >= coalesce(max(ts) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), ts) as ok,
    case when event_type = 'view' then null else value end as v from events)
select user_id,
  (select v from e x where x.user_id = e.user_id and ok and (not partial or v is not null) order by event_id desc limit 1) as value,
  (select props from e x where x.user_id = e.user_id and ok order by event_id desc limit 1) as raw_uri,
  (select value from e x where x.user_id = e.user_id and ok and not partial order by event_id desc limit 1) as full_value,
  min(ts) as first_seen, max(ts) as last_seen from e group by user_id""")
def latest_partial_state(t):
    e = t("events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.col("props").alias("raw_uri"), F.col("value").alias("full_value"), (F.col("event_type") == "purchase").alias("is_full"))
    return merge.coalesce_merge(e, ["user_id"], "ts", "event_id", ["value"], ["raw_uri"], ["full_value"], "is_full", {"first_seen": "ts"}, {"last_seen": "ts"})


_RUNS = """select user_id, event_id, ts, props, value, case event_type when 'signup' then 'running' when 'purchase' then 'finished' else 'incomplete' end as status,
  case when event_type = 'purchase' then ts end as finished_at, case when event_type <> 'view' then value end as counter from events"""


@query(f"""
with r as ({_RUNS})
select user_id, arg_max(props, event_id) as config, arg_max(counter, event_id) filter (counter is not null) as counter, min(ts) as started_at,
  arg_max(finished_at, event_id) filter (finished_at is not null) as finished_at,
  case when bool_or(status = 'finished') then 'finished' else arg_max(status, event_id) end as status, arg_max(status, event_id) as observed_status from r group by 1""")
def run_status_merge(t):
    e = t("events").select(
        "user_id", "event_id", F.col("ts").alias("started_at"), F.col("props").alias("config"), F.when(F.col("event_type") != "view", F.col("value")).alias("counter"),
        F.when(F.col("event_type") == "purchase", F.col("ts")).alias("finished_at"), F.expr("case event_type when 'signup' then 'running' when 'purchase' then 'finished' else 'incomplete' end").alias("status"))
    a = merge.run_merge(e, ["user_id"], "event_id", "status", ["config"], ["counter"], "started_at", "finished_at")
    b = merge.run_merge(e, ["user_id"], "event_id", "status", ["config"], ["counter"], "started_at", "finished_at", regress=True)
    return a.join(b.select("user_id", F.col("status").alias("observed_status")), "user_id")


@query("select user_id, event_type, event_id as seq, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1")
def decision_last_write(t):
    return merge.last_write(t("events").select("user_id", "event_type", F.col("event_id").alias("seq"), "value"), ["user_id", "event_type"])


@query("select o_custkey, o_orderpriority, o_orderkey as seq, o_orderdate, o_orderstatus from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def application_newest(t):
    o = t("orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("seq"), "o_orderdate", "o_orderstatus")
    return merge.newest(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "seq"])


@query("""
with o as (select case when o_orderpriority = '5-LOW' then -o_custkey - 1 else o_custkey end as k, * from orders),
ch as (select k, max(o_orderkey) as s, arg_max(o_orderstatus, o_orderkey) as st from o group by 1)
select coalesce(c_custkey, k) as c_custkey, case when k is null then c_mktsegment else st end as c_mktsegment, coalesce(c_name, 'order ' || s) as created_at, c_nationkey
from customer full join ch on k = c_custkey""")
def generic_upsert(t):
    # all customers are the current state; orders are changes, those of low priority of keys that aren't there yet
    c = t("customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("created_at"), "c_nationkey")
    key = F.when(F.col("o_orderpriority") == "5-LOW", -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    o = t("orders").select(key.alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("created_at"), F.col("o_orderkey").alias("seq"))
    return merge.upsert(c, o, ["c_custkey"], "seq")


@query("""
with p as (select c_custkey, c_mktsegment, c_acctbal >= 0 as active from customer where c_acctbal < 9000),
n as (select c_custkey, coalesce(max(case when o_orderstatus = 'P' then 'CHANGED' end), c_mktsegment) as c_mktsegment from customer left join orders on o_custkey = c_custkey
  where c_acctbal >= 9000 or o_orderkey is not null group by c_custkey, customer.c_mktsegment),
j as (select coalesce(p.c_custkey, n.c_custkey) as c_custkey, p.c_custkey is not null as had, n.c_custkey is not null as has, active, p.c_mktsegment as a, n.c_mktsegment as b
  from p full join n on p.c_custkey = n.c_custkey)
select c_custkey, case when not had then 'registered' when not has and not active then 'still_deleted' when not has then 'deleted' when not active then 'reactivated'
    when a = b then 'unchanged' else 'updated' end as change, case when has then 'active' else 'deleted' end as lifecycle, case when has then b else a end as segment,
  case when has then null when not active then timestamp '2024-01-05' else timestamp '2024-02-01' end as inactive_at from j""")
def snapshot_reconcile(t):
    c = t("customer")
    day = lambda d: F.lit(d).cast("timestamp")
    # known before: all with less than 9,000; there now: the rest and who ordered; in debt: deleted before
    p = c.filter("c_acctbal < 9000").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, "active").otherwise("deleted").alias("lifecycle"), F.when(F.col("c_acctbal") < 0, day("2024-01-05")).alias("inactive_at"),
        day("2024-01-01").alias("first_seen_at"), day("2024-01-31").alias("last_seen_at"))
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("changed"))
    n = c.join(o, "c_custkey", "left").filter("c_acctbal >= 9000 or changed is not null")
    n = n.select("c_custkey", F.when(F.col("changed"), "CHANGED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), day("2024-02-01").alias("observed_at"))
    return reconcile.reconcile(p, n, ["c_custkey"], ["c_mktsegment"]).select("c_custkey", "change", "lifecycle", F.col("c_mktsegment").alias("segment"), "inactive_at")


@query("""
select c_mktsegment, (c_acctbal > 0 and c_custkey % 2 = 0 and c_nationkey < 20) as can_evaluate,
  (c_acctbal > 0 and c_custkey % 2 = 0 and c_nationkey < 20 and c_custkey % 3 = 0 and c_acctbal < 5000) as can_act, count(*) as n from customer group by 1, 2, 3""")
def resume_selectable(t):
    c = t("customer").withColumn("can_evaluate", rules.selectable(F.col("c_acctbal") > 0, F.col("c_custkey") % 2 == 0, F.col("c_nationkey") < 20, F.lit(True)))
    act = rules.selectable_for_action(F.col("can_evaluate"), F.col("c_custkey") % 3 == 0, F.when(F.col("c_acctbal") < 5000, "published").otherwise("hidden"))
    return c.groupBy("c_mktsegment", "can_evaluate", act.alias("can_act")).agg(F.count("*").alias("n"))


# --- state -----------------------------------------------------------------


_CLAIMS = """
with recursive q as (
  select user_id, event_id as seq, 'run' || (user_id + (event_id % 5 = 0)::int) as by_run, ts as t, case when value > 250 then 'Timeout' end as err, props,
    case event_type when 'click' then 'SUBMITTING' when 'purchase' then 'SUBMITTED' when 'error' then case when event_id % 2 = 0 then 'FAILED_SAFE_TO_RETRY' else 'UNCERTAIN' end else 'acquire' end as kind,
    user_id * 3 + event_id % 3 as claim, row_number() over (partition by user_id * 3 + event_id % 3 order by event_id) as k from events),
fold as (
  select claim, 0::bigint as k, null::bigint as seq, null::varchar as kind, null::varchar as reason, null::varchar as run_id, null::varchar as status, 0 as attempts, null::timestamp as claimed, null::timestamp as changed, null::timestamp as submitted, null::timestamp as finished, null::varchar as error, null::varchar as evidence
  from (select distinct claim from q)
  union all
  select claim, k, seq, kind, reason, case when got then by_run else run_id end, case when not ok then status when got then 'CLAIMED' else kind end, attempts + got::int, case when got then t else claimed end, case when ok then t else changed end,
    case when got then null when ok and kind = 'SUBMITTED' then t else submitted end, case when not ok then finished when kind in ('SUBMITTED', 'UNCERTAIN', 'FAILED_SAFE_TO_RETRY') then t end, case when not ok then error when not got then err end, case when not ok then evidence when got then '{}' else props end
  from (select *, reason is null as ok, reason is null and kind = 'acquire' as got from (
    select f.claim, q.k, q.seq, q.kind, q.by_run, q.t, q.err, q.props, f.run_id, f.status, f.attempts, f.claimed, f.changed, f.submitted, f.finished, f.error, f.evidence,
      case when q.kind = 'acquire' then case when f.status is not null and f.status <> 'FAILED_SAFE_TO_RETRY' then 'held' end
        when f.status is null then 'not_claimed' when f.run_id <> q.by_run then 'other_owner'
        when not (f.status = 'CLAIMED' or (f.status = 'SUBMITTING' and q.kind in ('SUBMITTED', 'UNCERTAIN'))) then 'not_from_' || f.status end as reason
    from fold f join q on q.claim = f.claim and q.k = f.k + 1))
)"""


def _claims(t):
    kind = F.expr("case event_type when 'click' then 'SUBMITTING' when 'purchase' then 'SUBMITTED' when 'error' then if(event_id % 2 = 0, 'FAILED_SAFE_TO_RETRY', 'UNCERTAIN') else 'acquire' end")
    run = F.concat(F.lit("run"), (F.col("user_id") + (F.col("event_id") % 5 == 0).cast("long")).cast("string"))
    e = t("events").select((F.col("user_id") * 3 + F.col("event_id") % 3).alias("claim"), F.col("event_id").alias("seq"), run.alias("run_id"), F.lit("acc").alias("account_key"), kind.alias("kind"), F.col("ts").alias("at"),
                           F.when(F.col("value") > 250, "Timeout").alias("error_type"), F.col("props").alias("evidence"))
    return state.decide_claims(e, ["claim"])


@query(f"""{_CLAIMS}
select claim, 'acc' as account_key, run_id, status, attempts as attempt_count, claimed as claimed_at, changed as changed_at, submitted as submitted_at, finished as finished_at, error as error_type, null::varchar as error_message, evidence,
  (select count(*) from fold g where g.claim = f.claim and g.k > 0 and g.reason is null) as granted, (select count(*) from fold g where g.claim = f.claim and g.reason is not null) as refused
from fold f where status is not null qualify row_number() over (partition by claim order by k desc) = 1""")
def claim_fold(t):
    return state.claims_after(_claims(t), ["claim"])


@query(f"{_CLAIMS} select kind, reason, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from fold where reason is not null group by 1, 2")
def claim_refusals(t):
    return state.refusals(_claims(t), ["claim"]).groupBy("kind", "reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("""
with r as (select user_id, event_id, month(ts)::int + (day(ts) > 15)::int as sig, 7 as win, case when day(ts) > 15 then 30 else 20 end as size from events),
c as (select *, case when lag(sig) over w = sig and lag(size) over w = size then 0 else 1 end as ch from r window w as (partition by user_id order by event_id)),
p as (select *, sum(ch) over (partition by user_id order by event_id)::bigint as epoch from c),
o as (select *, coalesce(sum(least(win, size)) over (partition by user_id, epoch order by event_id rows between unbounded preceding and 1 preceding), 0) % size as start_offset from p)
select user_id, event_id, epoch, start_offset::bigint as start_offset, ((start_offset + 7) % size)::bigint as next_offset, start_offset + 7 >= size as wrapped from o""")
def cursor_reservation(t):
    late = F.dayofmonth("ts") > 15
    e = t("events").select("user_id", "event_id", (F.month("ts") + late.cast("int")).alias("sig"), F.lit(7).alias("win"), F.when(late, 30).otherwise(20).alias("size"))
    return state.reserve_windows(e, ["user_id"], "event_id", "sig", "size", "win").select("user_id", "event_id", "epoch", "start_offset", "next_offset", "wrapped")


@query("""
with o as (select o_custkey, o_orderkey, round(o_totalprice * 100)::bigint as c from orders),
p as (select *, coalesce(sum(c) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as prior from o)
select o_custkey, o_orderkey, greatest(50000000 - prior, 0) as available, prior < 50000000 as allowed from p""")
def quota_allocation(t):
    o = t("orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("c"))
    return state.allocate_quota(o, ["o_custkey"], "o_orderkey", "c", F.lit(50000000).cast("long")).select("o_custkey", "o_orderkey", "available", "allowed")


@query("""
with o as (select o_custkey, l_orderkey, any_value(case when o_orderstatus = 'P' then o_orderpriority end) as why, count(*) as items, sum(round(l_quantity))::bigint as q, sum((l_returnflag = 'R')::int)::bigint as returned
  from lineitem join orders on o_orderkey = l_orderkey group by 1, 2)
select o_custkey, count(*) as runs, sum(items)::bigint as items, sum(q)::bigint as q, sum(returned)::bigint as returned, greatest(1500 - sum(q), 0)::bigint as quota_left, arg_max(why, l_orderkey) filter (why is not null) as paused_reason from o group by 1""")
def account_rollup(t):
    li = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum(F.round("l_quantity").cast("long")).alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    j = li.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("why")), "l_orderkey")
    return report.roll_up(j, ["o_custkey"], ["items", "q", "returned"], F.lit(1500), "q", {"paused_reason": ("why", "l_orderkey")})


@query("""
with r as (select s_nationkey, s_suppkey, s_suppkey % 3 + 1 as runs from supplier), e as (select s_nationkey, s_suppkey, i as run_number from r, range(1, 4) t(i) where i <= runs),
s as (select *, row_number() over (order by run_number, s_suppkey) as slot from e)
select s_suppkey, run_number::int as run_number, slot, case when slot > 200 then 'future' when slot < 20 then 'expired' when s_nationkey = 3 then 'skipped_paused' when s_suppkey % 11 = 0 then 'skipped_quota' else 'due' end as state from s""")
def slot_interleave(t):
    s = state.interleave(t("supplier").withColumn("runs", (F.col("s_suppkey") % 3 + 1).cast("int")), "s_suppkey", "runs")
    start, now = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 03:20:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(start) + F.col("slot") * 60)
    st = state.slot_state(at, now, 180 * 60, F.col("s_nationkey") == 3, F.when(F.col("s_suppkey") % 11 == 0, 0).otherwise(1))
    return s.select("s_suppkey", "run_number", F.col("slot").cast("long").alias("slot"), st.alias("state"))


@query("""
select conv_id, arg_max(role, turn) as last_role, arg_max(text, turn) as last_text, max(turn) as last_turn, count(*) as messages,
  arg_max(role, turn) = 'assistant' or max(turn) < 2 as reply from conversations group by 1""")
def last_message(t):
    m = state.last_message(t("conversations"), ["conv_id"], "turn", ["role", "text"])
    return m.withColumn("reply", rules.needs_reply(F.when(F.col("last_role") == "assistant", "employer").otherwise("applicant"), F.col("last_turn") >= 2))


@query("""
with m as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where trim(text) <> '')
select conv_id, string_agg('[ ' || turn || ' ] ' || role || ': ' || text, chr(10) order by turn) as transcript, count(*) as lines from m where r <= 5 group by 1""")
def transcript_last5(t):
    line = F.concat(F.lit("[ "), F.col("turn").cast("string"), F.lit(" ] "), F.col("role"), F.lit(": "), F.col("text"))
    return state.transcript(t("conversations"), ["conv_id"], "turn", line, "text", 5)


# --- reports ---------------------------------------------------------------


@query("select o_orderstatus as state, count(*) as n from orders group by 1 union all select 'total', count(*) from orders")
def status_counts(t):
    c = report.counts(t("orders").withColumnRenamed("o_orderstatus", "state"), ["state"])
    return c.unionByName(c.agg(F.lit("total").alias("state"), F.sum("n").alias("n")))


@query("select event_type as reason, count(*) as n from events group by 1")
def reason_counts(t):
    return report.counts(t("events").withColumnRenamed("event_type", "reason"), ["reason"])


@query("select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as reasons from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def reason_histogram(t):
    h = report.histogram(t("events"), ["user_id"], "event_type")
    return h.select("user_id", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("reasons"))


@query("select ts::date as day, event_type, count(*) as n from events where ts >= timestamp '2024-01-25' - interval 30 days and ts < timestamp '2024-01-25' group by 1, 2")
def daily_counts_30d(t):
    return report.daily_counts(t("events"), "ts", "2024-01-25 00:00:00", 30, ["event_type"])


@query("select o_orderkey, o_orderdate, o_orderstatus, c_name, n_name from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey order by o_orderdate desc, o_orderkey desc limit 500")
def newest_500_named(t):
    o = report.newest(t("orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 500)
    c, n = t("customer"), t("nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, n["n_nationkey"] == c["c_nationkey"], "left").select("o_orderkey", "o_orderdate", "o_orderstatus", "c_name", "n_name")


@query("select o_orderkey, o_orderdate from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') order by o_orderdate, o_orderkey limit 10")
def pending_runs(t):
    done = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return report.newest(report.not_in(t("orders"), done, ["o_orderkey"]), [F.asc("o_orderdate"), F.asc("o_orderkey")], 10).select("o_orderkey", "o_orderdate")


@query("""
with s as (select p_partkey as v, case when p_size < 5 then '' else (p_partkey % 100 + 1)::varchar end as r from part)
select l_orderkey, l_linenumber from lineitem where exists (select 1 from s where v = l_partkey and (r = '' or r = l_suppkey::varchar))""")
def skip_lookup(t):
    s = t("part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") < 5, "").otherwise((F.col("p_partkey") % 100 + 1).cast("string")).alias("r"))
    li = t("lineitem").withColumn("r", F.col("l_suppkey").cast("string"))
    return report.already_skipped(li, s, "l_partkey", "r").select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def blacklist_anti(t):
    bad = t("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return report.not_in(t("orders"), bad, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""
with l as (select l_orderkey, max(l_shipdate) as shipped, max(l_linestatus) as st, min(l_suppkey) as s from lineitem group by 1)
select o_orderkey, array_to_string(list_filter([case when o_orderstatus is distinct from st then 'o_orderstatus_differs' end, case when c_nationkey is distinct from s_nationkey then 'nation_differs' end,
    case when o_orderdate > shipped then 'shipped_before_o_orderdate' end], lambda x: x is not null), ',') as violations
from orders join customer on c_custkey = o_custkey join l on l_orderkey = o_orderkey join supplier on s_suppkey = s""")
def proof_join(t):
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    li = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"), F.max("l_linestatus").alias("o_orderstatus"), F.min("l_suppkey").alias("s_suppkey"))
    li = li.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), "s_suppkey")
    return routing.agree(o, li, ["o_orderkey"], ["o_orderstatus", "nation"], [("o_orderdate", "shipped")]).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


@query("""
with l as (select l_orderkey, max(l_linenumber) as declared, count(*) as counted from lineitem group by 1)
select case when declared is null then 'incomplete' when declared = coalesce(counted, 0) then 'agrees' else 'differs' end as status, count(*) as n, sum(coalesce(counted, 0))::bigint as counted
from orders left join l on l_orderkey = o_orderkey group by 1""")
def run_summary_check(t):
    li = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    h = t("orders").select("o_orderkey").join(li.groupBy("o_orderkey").agg(F.max("l_linenumber").alias("declared")), "o_orderkey", "left")
    c = report.summary_checks(h, li, ["o_orderkey"], "declared")
    return c.groupBy("status").agg(F.count("*").alias("n"), F.sum("counted").alias("counted"))


@query("""
select o_orderpriority, least(floor(date_diff('day', o_orderdate::date, l_shipdate::date) / 30), 5)::bigint as bucket, count(*) as n, round(avg((l_returnflag = 'R')::int), 6) as returned, round(avg((l_linestatus = 'F')::int), 6) as closed
from lineitem join orders on o_orderkey = l_orderkey group by 1, 2""")
def conversion_by_age(t):
    j = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate"), "l_orderkey")
    j = j.withColumn("bucket", F.least(F.floor(F.datediff("l_shipdate", "o_orderdate") / 30), F.lit(5)).cast("long"))
    r = report.rates(j, ["o_orderpriority", "bucket"], {"returned": F.col("l_returnflag") == "R", "closed": F.col("l_linestatus") == "F"})
    return r.select("o_orderpriority", "bucket", "n", F.round("returned", 6).alias("returned"), F.round("closed", 6).alias("closed"))


@query("""
select o_orderkey, floor(date_diff('second', o_orderdate, timestamp '2001-09-01') / 86400)::bigint > 900 as is_old, o_orderstatus = 'F' as is_discarded from orders
where floor(date_diff('second', o_orderdate, timestamp '2001-09-01') / 86400)::bigint > 900 or o_orderstatus = 'F'""")
def stale_rows(t):
    now = F.lit("2001-09-01 00:00:00").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "discard").otherwise("open")
    o = t("orders").select("o_orderkey", rules.stale(F.col("o_orderdate"), status, now, 900).alias("is_old"), rules.stale(F.col("o_orderdate"), status, now, None).alias("is_discarded"))
    return o.filter("is_old or is_discarded")


@query("""
with e as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events)
select user_id, event_id, date_diff('second', before, ts) between 0 and 960 as instant, ((date_diff('second', before, ts) % 86400) + 86400) % 86400 <= 960 as instant_days_dropped
from e where before is not null""")
def instant_answer(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").select("user_id", "event_id", F.date_trunc("second", "ts").alias("ts")).withColumn("before", F.lag("ts").over(w)).filter("before is not null")
    return e.select("user_id", "event_id", rules.instant_answer(F.col("before"), F.col("ts")).alias("instant"), rules.instant_answer(F.col("before"), F.col("ts"), ignore_days=True).alias("instant_days_dropped"))


@query("""
select p_partkey, p_brand, p_size from part where p_brand <> 'Brand#11' and p_size >= 5 and p_size <= 45 and p_retailprice > 900 and p_retailprice < 1900
  and p_type like '%E%' and p_name is not null and p_size in (5, 10, 15, 20, 25, 30, 35, 40, 45, 6, 7, 8) and p_brand not in ('Brand#22', 'Brand#33')""")
def keyword_find(t):
    return rules.find(
        t("part"), "p_partkey", p_brand__ne="Brand#11", p_size__ge=5, p_size__le=45, p_retailprice__gt=900, p_retailprice__lt=1900, p_type__like="%E%", p_name__is_not=None,
        p_size__in=[5, 10, 15, 20, 25, 30, 35, 40, 45, 6, 7, 8], p_brand__not_in=["Brand#22", "Brand#33"]).select("p_partkey", "p_brand", "p_size")


# --- quality ---------------------------------------------------------------


@query("""
with c as (select 'customer_balance' as rule, sum((c_acctbal < 0)::int) as v, count(*) as r from customer union all
  select 'order_status', sum((o_orderstatus not in ('F', 'O'))::int), count(*) from orders union all
  select 'order_price', sum((o_totalprice < 0)::int), count(*) from orders union all
  select 'line_ship_after_order', sum((l_shipdate < o_orderdate)::int), count(*) from lineitem join orders on o_orderkey = l_orderkey union all
  select 'line_quantity', sum((not l_quantity between 1 and 45)::int), count(*) from lineitem union all
  select 'line_key_unique', (select count(*) from (select 1 from lineitem group by l_orderkey, l_partkey having count(*) > 1)), count(*) from lineitem union all
  select 'line_order_known', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)), count(*) from lineitem)
select rule, v::bigint as violations, r as rows from c""")
def dq_violations(t):
    o, li = t("orders"), t("lineitem")
    a = quality.violations(t("customer"), {"customer_balance": F.col("c_acctbal") >= 0})
    b = quality.violations(o, {"order_status": F.col("o_orderstatus").isin("F", "O"), "order_price": quality.counters_sound(F.col("o_totalprice"))})
    j = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    c = quality.violations(j, {"line_ship_after_order": quality.in_order(F.col("o_orderdate"), F.col("l_shipdate"))})
    d = quality.violations(li, {"line_quantity": F.col("l_quantity").between(1, 45)})
    n = li.agg(F.count("*").alias("rows"))
    e = quality.duplicate_keys(li, ["l_orderkey", "l_partkey"]).agg(F.count("*").alias("violations")).withColumn("rule", F.lit("line_key_unique"))
    f = quality.orphans(li, o, {"l_orderkey": "o_orderkey"}).agg(F.count("*").alias("violations")).withColumn("rule", F.lit("line_order_known"))
    # one row each
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e.unionByName(f).join(F.broadcast(n)))


@query("select sha256(text) as h, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_keys(t):
    return quality.duplicate_keys(t("documents").select(T.sha256(F.col("text")).alias("h")), ["h"])


@query("select l_orderkey, sha256('[' || string_agg('\"' || l_linenumber || '-' || l_partkey || '\"', ',' order by l_linenumber, l_partkey) || ']') as signature, count(*) as size from lineitem group by 1")
def catalogue_signature(t):
    li = t("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("pos"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("k"))
    return quality.catalogue_signature(li, "pos", "k", ["l_orderkey"])


# a digest tree as the operator builds it: levels by the number of rows, whatever that is, then one range after another from the rows up
_FP = """
select '{0}' as name, (select count(*) from {0}) as n, (
  with recursive d as (select sha256({1}) as d from {0}), levels as (select count(*) as level from (select count(*) as n from d), range(0, 7) r(k) where n // (256 ** k)::bigint > 4096),
  nodes as (select level, d as head, d from d, levels union all select level - 1, substr(head, 1, 2 * level), sha256(string_agg(d, '' order by head, d)) from nodes where level > 0 group by level, substr(head, 1, 2 * level))
  select sha256(coalesce(string_agg(d, '' order by head, d), '')) from nodes where level = 0) as fingerprint"""


def _as_json(*columns: str) -> str:
    return "'[' || " + " || ',' || ".join(f"coalesce(to_json({c}::varchar)::varchar, 'null')" for c in columns) + " || ']'"


@query(" union all ".join(_FP.format(n, _as_json(*cs)) for n, cs in (("region", ("r_regionkey", "r_name")), ("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "round(o_totalprice * 100)::bigint", "o_orderdate::date", "o_orderpriority")))))
def rowset_fingerprint(t):
    a = quality.rowset_fingerprint(t("region"), ["r_regionkey", "r_name"]).withColumn("name", F.lit("region"))
    return a.unionByName(quality.rowset_fingerprint(t("orders").withColumns({"price": cents("o_totalprice"), "day": F.to_date("o_orderdate")}), ["o_orderkey", "o_custkey", "o_orderstatus", "price", "day", "o_orderpriority"]).withColumn("name", F.lit("orders")))


# --- text and trees --------------------------------------------------------


_ENT = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"""
with p as (select page_id, html, list_filter(list_transform(regexp_split_to_array(html, '<[^>]*>'), lambda x: regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')), lambda x: x <> '') as parts from pages)
select page_id, sha256({_ENT.format("array_to_string(parts, chr(10))")}) as text_hash, length({_ENT.format("array_to_string(parts, chr(10))")}) as chars, len(parts)::int as fragments from p""")
def html_visible_text(t):
    v = T.visible_text(F.col("html"))
    n = F.size(F.filter(F.transform(F.split("html", "<[^>]*>"), lambda x: F.regexp_replace(x, r"^[\s]+|[\s]+$", "")), lambda x: x != ""))
    return t("pages").select("page_id", T.sha256(v).alias("text_hash"), F.length(v).cast("long").alias("chars"), n.alias("fragments"))


@query(rf"""
select page_id, {_ENT.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} as title, {_ENT.format("regexp_extract(html, '(?i)<meta name=" + '"generator" content="(.*?)"' + "', 1)")} as generator,
  len(list_distinct(regexp_extract_all(html, '\b[a-z][a-z0-9_.-]+@[a-z0-9][a-z0-9-]+(?:\.[a-z0-9][a-z0-9-]+)+\b')))::int as emails from pages""")
def page_facts(t):
    f = T.page_facts(F.col("html"))
    return t("pages").select("page_id", f.alias("f")).select("page_id", "f.title", "f.generator", F.size("f.emails").alias("emails"))


@query(f"""
with d as (select doc_id, lang, source, coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'вакансию') as title, trim(source) as company, ('0x' || substr(sha256(doc_id::varchar), 1, 2))::int % 3 as k from documents),
f as (select *, case lang when 'en' then '{L.FOCUS[0][1]}' when 'fr' then '{L.FOCUS[1][1]}' when 'de' then '{L.FOCUS[4][1]}' else '{L.FOCUS_OTHER}' end as focus,
  case when doc_id % 2 = 0 then 'По стеку вижу прямое пересечение: ' || source || ', ' || lang || '.' else '{L.SKILLS_OTHER}' end as skills from d)
select doc_id, 't' || (k + 1) as template_id, sha256(case k when 0 then 'Здравствуйте! Откликаюсь на вакансию «' || title || '» в ' || company || '. ' || focus || ' ' || skills || ' Буду рад обсудить задачи команды.'
  when 1 then 'Добрый день! Заинтересовала позиция «' || title || '» в ' || company || '. ' || focus || ' ' || skills || ' Готов подробнее рассказать о релевантном опыте.'
  else 'Здравствуйте! Хочу откликнуться на позицию «' || title || '» в ' || company || '. ' || skills || ' ' || focus || ' Буду рад познакомиться и обсудить, чем могу быть полезен команде.' end) as message_hash from f""")
def text_hash_template(t):
    domains = F.expr("case lang when 'en' then array('llm') when 'fr' then array('cv') when 'de' then array('ml') else cast(array() as array<string>) end")
    skills = F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    d = _titled(t("documents"))
    made = T.letter(F.col("title"), F.col("source"), domains, skills, F.lit(None).cast("string"), F.col("doc_id").cast("string"))
    return d.select("doc_id", made.alias("m")).select("doc_id", "m.template_id", T.sha256(F.col("m.message")).alias("message_hash"))


@query("select event_id, date_trunc('second', ts) as utc_time, event_id % 5 = 0 as is_rejected from events where event_id % 5 <> 0 union all select event_id, null, true from events where event_id % 5 = 0")
def time_normalise(t):
    shown = F.date_format(F.expr("ts + interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    e = t("events").select("event_id", T.zoned_time(F.when(F.col("event_id") % 5 == 0, shown).otherwise(F.concat(shown, F.lit("+0300")))).alias("utc_time"))
    return e.withColumn("is_rejected", F.col("utc_time").isNull())


@query("select event_type, sum((props::json ->> '$.k')::bigint)::bigint as total, count(props::json ->> '$.k') as known from events group by 1")
def json_props(t):
    k = T.first_of_paths(F.col("props"), ["$.missing", "$.k"]).try_cast("long")
    return t("events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("known"))


@query("""
select o_orderkey as id, c_name as employer, coalesce(case when o_totalprice > 200000 then round(o_totalprice * 100)::bigint end, round(c_acctbal * 100)::bigint) as salary_from,
  o_orderpriority in ('1-URGENT', '2-HIGH') as is_remote, coalesce(nullif(trim(case when o_orderstatus = 'P' then '' else o_orderstatus end), ''), c_mktsegment) as employment
from orders join customer on c_custkey = o_custkey""")
def posting_projection(t):
    from jobmill.operators.mapping import canonical_posting

    j = t("orders").join(t("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    money = lambda c: F.struct(cents(c).alias("from"), F.lit(None).cast("long").alias("to"), F.lit("RUR").alias("currency"))
    p = j.select(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("posting").alias("name"), F.struct("c_name").alias("e"), F.struct(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("id")).alias("employer"),
        F.when(F.col("o_totalprice") > 200000, money("o_totalprice")).alias("salary"), money("c_acctbal").alias("salary_range"),
        F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "Remote").alias("id")).alias("schedule"), F.array(F.struct(F.when(F.col("o_orderpriority") == "2-HIGH", "remote").alias("id"))).alias("work_format"),
        F.struct(F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("id")).alias("employment"), F.struct(F.col("c_mktsegment").alias("id")).alias("employment_form")).alias("v"))
    c = canonical_posting(p, "v")
    return c.select(F.col("source_entity_id").cast("long").alias("id"), F.col("company_name").alias("employer"), F.col("salary_from").cast("long").alias("salary_from"), F.col("remote").alias("is_remote"), F.col("employment_type").alias("employment"))


@query("""
with recursive a as (select 'r' || r_regionkey as id, null::varchar as parent, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer),
w as (select id, name, 0 as depth, name as path from a where parent is null union all select a.id, a.name, depth + 1, path || '/' || a.name from a join w on a.parent = w.id)
select id, depth::int as depth, path, repeat('  ', depth) || name as label from w""")
def area_tree(t):
    r = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    c = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("name"))
    return report.area_tree(r.unionByName(n).unionByName(c), "id", "parent", "name").select("id", "depth", F.array_join("path", "/").alias("path"), "label")


@query(r"""
with d as (select doc_id, text, regexp_extract_all(text, '\b[A-Z0-9]{64,}\b|\b[a-fA-F0-9]{32,}\b') as found from documents)
select doc_id, len(found)::int as masked, length(text) - coalesce(list_sum(list_transform(found, lambda x: length(x))), 0)::bigint as chars_left,
  sha256(regexp_replace(text, '\b[A-Z0-9]{64,}\b|\b[a-fA-F0-9]{32,}\b', '#', 'g')) as shape from d""")
def redact_tokens(t):
    d = t("documents").withColumn("r", T.redact(F.col("text")))
    token = r"\b[A-Z0-9]{64,}\b|\b[a-fA-F0-9]{32,}\b"
    found = F.regexp_extract_all("text", F.lit(f"({token})"), F.lit(1))
    hidden = F.length("text") - F.length(F.regexp_replace(F.col("r"), r"\*{32,}", ""))
    return d.select("doc_id", F.size(found).alias("masked"), (F.length("text") - hidden).cast("long").alias("chars_left"), T.sha256(F.regexp_replace("r", r"\*{32,}", "#")).alias("shape"))
