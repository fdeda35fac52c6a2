"""Registered queries of operators over long sequences: logs, snapshots, histories of hot keys, nested texts; each with its DuckDB SQL."""

from pyspark.sql import functions as F

from jobmill.functions import text as T
from jobmill.operators import mapping, merge, reconcile, report, state
from jobmill.operators.spread import spread
from jobmill.plans import discovery
from jobmill.plans.queries import query
from jobmill.sources import raw

_LINE = """case event_type when 'error' then 'Traceback (most recent call last):' when 'purchase' then strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - INFO - done' else '  File ' || event_id end"""


@query(f"""
with l as (select user_id % 5 as log, event_id as pos, {_LINE} as line, case when event_type = 'purchase' then date_trunc('second', ts) end as tm, event_type = 'error' as head from events),
r as (select *, last_value(tm ignore nulls) over w as now, max(case when tm is not null then pos end) over w as lt, max(case when head then pos end) over w as lh, lag(pos) over v as pp, lag(line) over v as pl
  from l window w as (partition by log order by pos rows between unbounded preceding and current row), v as (partition by log order by pos)),
x as (select log, pos as f, 0 as place, pp as pos, pl as line from r where now >= timestamp '2024-01-06' and head
  union all select log, pos, 1, pos, line from r where now >= timestamp '2024-01-06' and lh > coalesce(lt, -1))
select log, f as head_or_line, place, pos, line from x qualify row_number() over (partition by log order by f desc, place desc) <= 1000""")
def log_tracebacks(t):
    line = F.when(F.col("event_type") == "error", "Traceback (most recent call last):").when(F.col("event_type") == "purchase", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - INFO - done"))).otherwise(F.concat(F.lit("  File "), F.col("event_id").cast("string")))
    e = t("events").select((F.col("user_id") % 5).alias("log"), F.col("event_id").alias("pos"), line.alias("line"))
    return report.traceback_lines(e, ["log"], "pos", "line", "2024-01-06 00:00:00", span=512)


@query("""
with e as (select event_id, event_id % 5 as shape, event_type, props, (props::json ->> '$.k') as k from events)
select event_id, case shape when 0 then k when 1 then k when 2 then 'own' when 3 then '[1,{"k":2}]' end as value from e""")
def key_anywhere(t):
    e = t("events").withColumn("shape", F.col("event_id") % 5)
    text = (
        F.when(F.col("shape") == 0, F.col("props")).when(F.col("shape") == 1, F.concat(F.lit('{"a": [{"x": "k"}, {"k": null}, [], ['), "props", F.lit(']], "b": {"k": 0}}')))
        .when(F.col("shape") == 2, F.concat(F.lit('{"n": '), "props", F.lit(', "k": "own"}'))).when(F.col("shape") == 3, F.lit('[{"k": [1, {"k": 2}]}]')).otherwise(F.concat(F.lit('{"k": null, "deep": '), "props", F.lit("}"))))
    return e.select("event_id", T.first_of_key(text, "k").alias("value"))


@query("""
with snapshots as (select distinct c_nationkey as account, date_trunc('month', o_orderdate)::timestamp as seen_at from orders join customer on c_custkey = o_custkey),
sound as (select account, seen_at, row_number() over (partition by account order by seen_at) as k from snapshots where (account + month(seen_at)) % 6 <> 0),
seen as (select c_nationkey as account, c_custkey as item, date_trunc('month', o_orderdate)::timestamp as seen_at, max(o_orderstatus) as status from orders join customer on c_custkey = o_custkey group by all),
grid as (select i.account, i.item, s.seen_at, s.k, n.status, n.item is not null as there from (select distinct account, item from seen) i join sound s using (account) left join seen n on n.account = i.account and n.item = i.item and n.seen_at = s.seen_at),
r as (select *, coalesce(bool_or(there) over b, false) as ever, coalesce(lag(there) over w, false) as before, last_value(case when there then status end ignore nulls) over b as last_status
  from grid window w as (partition by account, item order by k), b as (partition by account, item order by k rows between unbounded preceding and 1 preceding))
select account, item, seen_at as observed_at, case when there and not ever then 'registered' when there and not before then 'reactivated' when there and status = last_status then 'unchanged' when there then 'updated' else 'deleted' end as change,
  case when there then status else last_status end as status from r where there or before""")
def resume_lifecycles(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("account"), F.col("c_custkey").alias("item"), F.date_trunc("month", "o_orderdate").alias("observed_at"), "o_orderstatus")
    snapshots = o.select("account", "observed_at").distinct().withColumn("sound", (F.col("account") + F.month("observed_at")) % 6 != 0)
    seen = o.groupBy("account", "item", "observed_at").agg(F.max("o_orderstatus").alias("status"))
    return reconcile.lifecycle_events(snapshots, seen, ["account"], "item", ["status"])


@query("""
with e as (select event_type, event_id, ts, value, props, user_id % 3 = 0 as is_full, case when user_id % 4 = 0 then value end as v from events),
o as (select *, ts >= coalesce(max(ts) over (partition by event_type order by event_id rows between unbounded preceding and 1 preceding), ts) as ok from e)
select event_type, arg_max(struct_pack(v := v), event_id) filter (ok and (is_full or v is not null)).v as v, arg_max(props, event_id) filter (ok) as props, arg_max(value, event_id) filter (ok and is_full) as value, min(ts) as first_seen, max(ts) as last_seen
from o group by 1""")
def hot_key_merge(t):
    e = t("events").select("event_type", "event_id", "ts", "value", "props", (F.col("user_id") % 3 == 0).alias("is_full"), F.when(F.col("user_id") % 4 == 0, F.col("value")).alias("v"))
    return merge.coalesce_merge(e, ["event_type"], "ts", "event_id", ["v"], ["props"], ["value"], "is_full", {"first_seen": "ts"}, {"last_seen": "ts"}, chunk=F.floor(F.col("event_id") / 512))


@query("""
with p as (select o_custkey as run, l_returnflag as q, l_linenumber as page, l_partkey, row_number() over (partition by o_custkey, l_returnflag, l_linenumber order by l_orderkey, l_partkey) - 1 as place from lineitem join orders on o_orderkey = l_orderkey),
i as (select *, case q when 'R' then 0 when 'A' then 1 else 2 end as qp from p where not (run % 7 = 0 and q = 'A' and page >= coalesce((select min(page) from p b where b.run = p.run and b.q = p.q and b.page >= 3), 99))),
k as (select run, l_partkey, q, min(qp * 1000000 + page * 10000 + place) as first from i group by all),
g as (select run, l_partkey, q, page, min(qp * 1000000 + page * 10000 + place) as first from i group by all)
select 'run' || run as run_id, l_partkey::varchar as vacancy_id, string_agg(q, ',' order by first) as query_keys,
  (select string_agg(q || page, ',' order by first) from g where g.run = k.run and g.l_partkey = k.l_partkey) as pages, (select count(*) from i where i.run = k.run and i.l_partkey = k.l_partkey) as observations from k group by run, l_partkey""")
def page_lineage(t):
    """Pages as raw objects made of order lines; where a run divides 7, its pages of query A from 3 on begin with a broken one."""
    li, n = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber"), t("lineitem").count()
    j = spread(li, ["l_orderkey"], n).join(spread(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"], n), "l_orderkey")
    j = spread(j.withColumn("run_id", F.concat(F.lit("run"), F.col("o_custkey").cast("string"))), ["run_id"], n)
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_partkey"))), lambda x: F.struct(x["l_partkey"].alias("id")))
    p = j.groupBy("run_id", "o_custkey", "l_returnflag", "l_linenumber").agg(items.alias("items"))
    broken = (F.col("o_custkey") % 7 == 0) & (F.col("l_returnflag") == "A") & (F.col("l_linenumber") >= 3)
    key = F.concat(F.lit("batches/date=2024-01-01/run_id="), "run_id", F.lit("/discovery/queries/query="), F.col("l_returnflag"), F.lit("/page="), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(".json"))
    objects = p.select(F.lit("page").alias("kind"), "run_id", key.alias("key"), F.when(broken, F.lit('{"items": {"id": 1}}')).otherwise(F.to_json(F.struct("items"))).cast("binary").alias("body"))
    _, found = discovery.page_rows(objects)
    place = F.when(F.col("query_key") == "R", 0).when(F.col("query_key") == "A", 1).otherwise(2)
    queries = p.select("run_id", F.col("l_returnflag").alias("query_key")).distinct().withColumns({"query_pos": place, "query_set": F.lit("set")})
    c = discovery.candidates(found, queries)
    short = F.transform("page_keys", lambda k: F.concat(F.regexp_extract(k, "query=([^/]+)", 1), F.regexp_extract(k, r"page=0*(\d+)", 1)))
    return c.select("run_id", "vacancy_id", F.array_join("query_keys", ",").alias("query_keys"), F.array_join(short, ",").alias("pages"), "observations")


@query("""
with e as (select user_id, event_id, event_type, props, sum((event_type = 'signup')::int) over (partition by user_id order by event_id) as epoch from events),
p as (select *, min(case when event_type = 'error' then event_id end) over (partition by user_id, epoch order by event_id rows between unbounded preceding and 1 preceding) as since from e)
select user_id, event_id, case when since is null then 'executed' else 'paused' end as status, since as paused_since, (select props from events x where x.event_id = since) as paused_reason from p""")
def account_isolation(t):
    rows = state.isolate_accounts(t("events"), ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_type") == "signup", "props")
    return rows.select("user_id", "event_id", "status", "paused_since", "paused_reason")


@query("""
with l as (select o_orderkey, 't' || (('0x' || substr(sha256(o_custkey || '/' || o_orderkey), 1, 2))::int % 3 + 1) as template_id, o_orderpriority from orders),
a as (select l_orderkey, bool_or(l_returnflag = 'R') as answered, bool_and(l_linestatus = 'F') as closed from lineitem group by 1)
select template_id, o_orderpriority, count(*) as n, round(avg(coalesce(answered, false)::int), 6) as answered, round(avg(coalesce(closed, false)::int), 6) as closed from l left join a on l_orderkey = o_orderkey group by 1, 2""")
def template_conversion(t):
    none = F.array().cast("array<string>")
    seed = F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    letters = t("orders").select("o_orderkey", "o_orderpriority", T.letter(F.lit("x"), F.lit(None).cast("string"), none, none, F.lit(None).cast("string"), seed)["template_id"].alias("template_id"))
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("answered"), F.bool_and(F.col("l_linestatus") == "F").alias("closed"))
    r = report.conversion_by_letter(letters, a, ["o_orderkey"], ["template_id", "o_orderpriority"], {"answered": F.col("answered"), "closed": F.col("closed")})
    return r.select("template_id", "o_orderpriority", "n", F.round("answered", 6).alias("answered"), F.round("closed", 6).alias("closed"))


@query("select l_orderkey as id, count(*) as n from lineitem group by 1")
def index_ids(t):
    return raw.index_ids(raw.read_index(t("lineitem").withColumnRenamed("l_orderkey", "id"), ["id", "l_shipdate", "absent"], ("id",)))


@query("""
select o_orderkey::varchar as id, c_name as company, round(o_totalprice * 100)::bigint as salary_from, o_orderstatus = 'F' as archived, c_custkey::varchar as company_id from orders join customer on c_custkey = o_custkey
where c_acctbal >= 0 and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def synced_canonical(t):
    """Postings of an index, as raw, canonical and operational rows; without an employer's name they are rejected."""
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    v = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("posting").alias("name"), F.struct(F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.col("c_custkey").cast("string").alias("id")).alias("employer"),
                 F.struct(F.round(F.col("o_totalprice") * 100).cast("long").alias("from")).alias("salary"), (F.col("o_orderstatus") == "F").alias("archived"))
    index = raw.read_index(t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), ["id"], ("id",))
    good, _ = mapping.synced(raw.sync_postings(index, j.select(F.col("o_orderkey").alias("id"), v.alias("v"))), "v")
    return good.select(F.col("source_entity_id").alias("id"), F.col("company_name").alias("company"), F.col("salary_from").cast("long").alias("salary_from"), F.col("flags.archived").alias("archived"), "company_id")
