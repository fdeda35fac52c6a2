"""Backfill: from the tree of raw objects to current state, by whole runs.

``parse`` types every object and checks it against its path, its run header and
its neighbours; ``current_state`` merges the rows of sound runs. A run with one
broken object contributes nothing and stops no other run. Both are plans over
``objects``, the classified rows of ``sources.raw``; store them partitioned by
``name`` (``streaming.materialise.store_objects``), then each kind reads its
own files only. Replaying a run changes nothing.
"""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.functions.text import optional_text
from jobmill.operators import mapping, merge, routing
from jobmill.plans.contracts import CONTRACTS, EVENTS, check, split
from jobmill.sources.raw import APPLICATION_KEY, candidate_keys, discover_runs, relative_key

#: Fields of a posting that reach current state; the rest of its payload stays in the raw tree.
POSTING = (
    "id string, name string, employer struct<id:string,name:string>, area struct<id:string,name:string>, alternate_url string, published_at string, description string, salary struct<from:string,to:string,currency:string>,"
    " salary_range struct<from:string,to:string,currency:string>, experience struct<id:string>, schedule struct<id:string>, work_format array<struct<id:string>>, employment struct<id:string>, employment_form struct<id:string>,"
    " relations array<string>, has_test boolean, response_url string, response_letter_required boolean, archived boolean, closed_for_applicants boolean"
)
# Keys of a decision's open part that are kept.
DECISION_METADATA = ["vacancy_title", "company_name", "submission_mode", "has_test", "search_item_uri", "vacancy_uri", "error_type", "error"]
RULE = "run_id string, key string, rule string"
#: Tables that are written at the same time.
AT_ONCE = 4

#: Rule id to condition over o (observation), e (its work items), h (run header) and the vacancy of the path; null is broken.
SIDECAR_RULES = {
    "observation_identity": "o.account_key = h.account_key and o.profile_id = h.profile_id",
    "work_items_identity": "e.account_key = h.account_key and e.source_profile = h.profile_id",
    "work_item_count": "o.evaluation_candidate_count = size(e.evaluations)",
    "fan_out": "array_sort(e.evaluations.source_resume_id) = if(o.full_fetch_status = 'fetched', array_sort(h.resume_ids), array_repeat('', 0))",
    "resume_projection": "o.candidate_source_resume_ids = e.evaluations.source_resume_id",
    "binding_projection": "o.candidate_resume_keys = e.evaluations.binding_key",
    "target_projection": "o.candidate_target_keys = e.evaluations.target_key",
    "binding_details": "to_json(o.candidate_bindings) = to_json(transform(e.evaluations, x -> named_struct('source_resume_id', x.source_resume_id, 'binding_key', x.binding_key, 'target_key', x.target_key, 'binding_version', x.binding_version, 'auto_apply', x.auto_apply)))",
    "work_item_identity": "forall(e.evaluations, x -> x.account_key = h.account_key and x.source_profile = h.profile_id and x.vacancy_id = vacancy_id"
    " and x.duplicate_key = named_struct('account_key', x.account_key, 'source_profile', x.source_profile, 'source_resume_id', x.source_resume_id, 'vacancy_id', x.vacancy_id))",
    "work_item_binding": "forall(e.evaluations, x -> exists(h.bindings, b -> b.source_resume_id = x.source_resume_id and b.binding_key = x.binding_key and b.target_key = x.target_key and b.binding_version = x.binding_version and b.query_sets = x.resume_query_sets))",
    "provenance": "forall(e.evaluations, x -> x.full_fetch_status = o.full_fetch_status and x.matched_query_keys = o.matched_query_keys and x.matched_query_sets = o.matched_query_sets)",
    "overlap_flag": "forall(e.evaluations, x -> x.provenance_overlap.has_overlap = (size(x.provenance_overlap.matched_query_sets) > 0))",
}
#: The same over s (summary), h and the counted rows.
_SUMMARY = {"prefix": "trim(BOTH '/' FROM s.s3_prefix) = concat('batches/date=', date, '/run_id=', run_id)", "finished_before_start": "try_to_timestamp(s.finished_at) >= h.started_at"}
SUMMARY_RULES = {
    2: _SUMMARY | {"live": "s.live = h.live"},
    3: _SUMMARY | {
        "summary_identity": "s.account_key = h.account_key and s.profile_id = h.profile_id",
        "rotation": "s.queries_selected = h.queries and s.queries_executed <= s.queries_selected and s.query_catalog_size = h.catalog_size and s.query_catalog_signature = h.catalog_signature"
        " and s.query_cursor_start = h.cursor_start and s.query_cursor_next = h.cursor_next and s.query_rotation_wrapped = h.wrapped",
        "candidate_count": "s.candidate_count = candidates", "work_item_total": "s.evaluation_candidate_count = work_items",
    },
}
#: The same over o (outcome), q (request), r (result), b and a (posting before and after), h.
APPLICATION_RULES = {
    "proof_missing": "o.application_run_id is not null and o.application_result_uri is not null and o.submission_mode is not null and o.confirmed is not null",
    "result_uri": "result_path.name = 'application_result'", "application_run": "result_path.run_id = o.application_run_id", "application_vacancy": "result_path.vacancy_id = vacancy_id",
    "request": "size(q.violations) = 0", "result": "size(r.violations) = 0", "before": "size(b.violations) = 0", "after": "get_json_object(r.v.confirmation_error, '$.stage') <=> 'vacancy_after' or size(a.violations) = 0",
    "profile_or_resume": "q.v.profile_id = h.profile_id and r.v.profile_id = h.profile_id and q.v.resume_id = h.resume_id and r.v.resume_id = h.resume_id",
    "account": "h.account_key is null or (q.v.account_key = h.account_key and r.v.account_key = h.account_key)",
    "mode": "q.v.submission_mode = o.submission_mode and r.v.submission_mode = o.submission_mode", "status": "r.v.status = o.status and r.v.confirmed = o.confirmed",
    "times_reversed": "try_to_timestamp(r.v.finished_at) >= try_to_timestamp(q.v.requested_at)", "cover_letter_uri": "cover_error is null",
}


def broken(rules: dict[str, str]) -> Column:
    """Ids of the rules that don't hold; a null counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), k) for k, c in rules.items()]), lambda x: x.isNotNull())


def typed(objects: DataFrame, name: str, contract: str, payload: str | None = None) -> DataFrame:
    """Objects of one name: date, run_id, vacancy_id, key, sha256, observed_at, v, violations (contract, event, path, checksum); a key read twice counts once, its newest object."""
    c = check(objects.filter(F.col("name") == name), CONTRACTS[contract])
    fields = CONTRACTS[contract].schema.fieldNames()
    found = []
    if contract in EVENTS:
        events, version = EVENTS[contract]
        of_kind = reduce(lambda x, y: x | y, [F.coalesce(F.col("v.event_type").endswith(f".{e}"), F.lit(False)) for e in events])
        found += [F.when(~of_kind, "event_type"), F.when(~F.col("v.schema_version").eqNullSafe(version), "schema_version")]
    found += [F.when(~F.col("v.run_id").eqNullSafe(F.col("run_id")), "path_run_id")] if "run_id" in fields else []
    vacancy = "v.vacancy_id" if "vacancy_id" in fields else "v.id" if "id" in fields else None
    found += [F.when(~optional_text(F.col(vacancy)).eqNullSafe(F.col("vacancy_id")), "path_vacancy_id")] if vacancy else []
    found += [F.col("error")] if "error" in objects.columns else []
    seen = F.col("observed_at") if "observed_at" in objects.columns else F.col("last_modified")
    more = ([F.from_json(F.col("body").cast("string"), payload).alias("payload")] if payload else []) + (["rest"] if "rest" in c.columns else [])
    c = c.select("date", "run_id", "vacancy_id", "key", "sha256", seen.alias("observed_at"), "v", *more, F.concat("violations", F.filter(F.array(*found), lambda x: x.isNotNull())).alias("violations"))
    return merge.newest(c, ["key"], ["observed_at", "sha256"])


def headers(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound run headers of both versions, quarantine): run_id, date, version, h."""
    rows = objects.filter("kind = 'run' and name = 'run'").withColumn("_version", F.get_json_object(F.col("body").cast("string"), "$.schema_version").try_cast("int"))
    started = F.try_to_timestamp("v.started_at")
    heads, bad = [], []
    for version, contract in ((3, "observe_run"), (2, "apply_run")):
        t = typed(rows.filter(F.col("_version") == version), "run", contract)
        good, out = split(t.withColumn("violations", F.concat("violations", F.when(~F.to_date(started).eqNullSafe(F.col("date")), F.array(F.lit("path_date"))).otherwise(F.array().cast("array<string>")))), ["run_id", "key"])
        bad.append(out)
        v3 = version == 3

        def of(name: str, kind: str, there: bool = v3, name_in: str | None = None) -> Column:
            return (F.col(f"v.{name_in or name}") if there else F.lit(None)).cast(kind).alias(name)

        binding = CONTRACTS["observe_run"].schema["active_bindings"].dataType.simpleString()
        heads.append(good.select("run_id", "date", F.lit(version).alias("version"), F.struct(
            F.col("v.account_key").alias("account_key"), F.col("v.profile_id").alias("profile_id"), of("resume_id", "string", not v3), of("live", "boolean", not v3), started.alias("started_at"), of("resume_ids", "array<string>", name_in="source_resume_ids"),
            of("bindings", binding, name_in="active_bindings"), (F.size("v.query_keys") if v3 else F.lit(None)).cast("int").alias("queries"), of("query_keys", "array<string>"), of("query_set_keys", "array<string>"), of("catalog_size", "int", name_in="query_catalog_size"),
            of("catalog_signature", "string", name_in="query_catalog_signature"), of("cursor_start", "int", name_in="query_cursor_start"), of("cursor_next", "int", name_in="query_cursor_next"), of("wrapped", "boolean", name_in="query_rotation_wrapped"),
            of("search", "string", not v3), F.col("v.area").cast("string").alias("area_id"), F.col("v.period").alias("period_days"), F.col("v.pages").alias("pages"), F.col("v.per_page").alias("per_page"),
            of("max_responses", "int", not v3), of("professional_roles", "array<string>", not v3), of("cover_letter_mode", "string", not v3)).alias("h")))
    unknown = rows.filter("_version is null or _version not in (2, 3)").select("run_id", "key", F.lit("unknown_version").alias("rule"))
    clash = discover_runs(objects).filter("clash").select("run_id", F.lit(None).cast("string").alias("key"), F.lit("several_dates").alias("rule"))
    return heads[0].unionByName(heads[1]), reduce(DataFrame.unionByName, [*bad, unknown, clash])


def parse(objects: DataFrame, bucket: str, prefix: str, versions: tuple[int, ...] = (3, 2)) -> tuple[dict[str, DataFrame], DataFrame]:
    """(typed parts by kind, quarantine(run_id, key, rule)). An object below no sound header is left out with its run.

    versions: 3 for the parts of runs that observe, 2 for those of runs that apply; runs of other versions are the caller's to leave out.
    """
    heads, bad_heads = headers(objects)
    bad = [bad_heads]
    head = heads.select("run_id", "version", "h")

    def kind(name: str, contract: str, version: int | None, payload: str | None = None, group: str = "candidate") -> DataFrame:
        t = typed(objects.filter(F.col("kind") == group), name, contract, payload)
        t = t.join(head if version is None else head.filter(F.col("version") == version), "run_id")
        good, out = split(t, ["run_id", "key"])
        bad.append(out)
        return good

    def failing(df: DataFrame, rules: Column, key: str = "key") -> None:
        bad.append(df.select("run_id", F.col(key).alias("key"), F.explode(rules).alias("rule")))

    keys = candidate_keys(objects).drop("date")
    need = [F.when(F.col("search_item").isNull(), "search_item_missing")] + [F.when((F.col("version") == 3) & F.col(n).isNull(), f"{n}_missing") for n in ("observation", "evaluation_candidates")]
    failing(keys.join(head, "run_id").withColumn("key", F.lit(None).cast("string")), F.filter(F.array(*need), lambda x: x.isNotNull()))

    parts = {"heads": heads, "keys": keys, "search_item": kind("search_item", "search_item", None, POSTING), "vacancy": kind("vacancy", "vacancy", None, POSTING)}
    full = mapping.canonical_posting(parts["vacancy"], "payload", provenance=["run_id", "key"])
    bad.append(full.filter(~F.col("valid")).select("run_id", "key", F.lit("posting_incomplete").alias("rule")))

    counted = keys.groupBy("run_id").agg(F.count("*").alias("candidates"))

    def summary(version: int, contract: str, items: DataFrame | None) -> None:
        t = kind("summary", contract, version, group="run").withColumnRenamed("v", "s").join(counted, "run_id", "left")
        t = (t.join(items, "run_id", "left") if items is not None else t.withColumn("work_items", F.lit(0).cast("long"))).na.fill(0, ["candidates", "work_items"])
        failing(t, broken(SUMMARY_RULES[version]))
        parts[f"summary{version}"] = t

    if 3 in versions:
        # an observation with its work items: both sides of one candidate, one row
        on = ["run_id", "vacancy_id"]
        seen = kind("observation", "observation", 3).withColumnRenamed("v", "o")
        work = kind("evaluation_candidates", "evaluation_candidates", 3).select(*on, F.col("v").alias("e"))
        pairs = seen.join(work, on)
        failing(pairs, broken(SIDECAR_RULES))
        uris = {"search_item_uri": "search_item", "vacancy_uri": "vacancy", "evaluation_candidates_uri": "evaluation_candidates"}
        resolved = routing.uris_resolve(pairs.select(*on, *[F.col(f"o.{u}").alias(u) for u in uris]), keys.select(*on, *uris.values()), on, uris, lambda u: relative_key(u, bucket, prefix)["key"])
        failing(resolved.withColumn("key", F.lit(None).cast("string")), F.col("violations"))
        parts["observed"] = pairs
        summary(3, "observe_summary", pairs.groupBy("run_id").agg(F.sum(F.size("e.evaluations")).alias("work_items")))
    if 2 in versions:
        parts["decision"] = kind("decision", "decision", 2)
        summary(2, "apply_summary", None)
        outcomes = kind("outcome", "outcome", 2).withColumn("event_type", F.regexp_extract("v.event_type", r"[^.]+$", 0))
        proofs = proven(merge.applications_from(outcomes, "event_type", "application_failed").withColumnRenamed("v", "o"), objects, bucket, prefix)
        failing(proofs, broken(APPLICATION_RULES))
        parts["applied"] = proofs
    return parts, reduce(DataFrame.unionByName, bad)


def store_parts(parts: dict[str, DataFrame], quarantine: DataFrame, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same, each part written once below ``path`` and read from there, so that what follows reads no raw object again."""
    spark = quarantine.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    # small jobs that don't wait for each other
    with ThreadPoolExecutor(AT_ONCE) as pool:
        todo = {n: pool.submit(stored, d, n) for n, d in (parts | {"quarantine": quarantine}).items()}
        done = {n: t.result() for n, t in todo.items()}
    return {n: done[n] for n in parts}, done["quarantine"]


def proven(outcomes: DataFrame, objects: DataFrame, bucket: str, prefix: str) -> DataFrame:
    """Outcomes o with the four objects of the application that each points to: q, r, b, a (structs of v, violations, key; null where absent), result_path, cover_error."""
    key = relative_key(F.col("o.application_result_uri"), bucket, prefix)["key"]
    names = ["date", "run_id", "vacancy_id", "name"]
    out = outcomes.withColumn("_key", key).withColumn("result_path", F.struct(*[F.regexp_extract("_key", APPLICATION_KEY, i + 1).alias(n) for i, n in enumerate(names)]))
    out = out.withColumn("_at", F.regexp_extract("_key", r"^(.*)/[^/]+$", 1)).withColumn("cover_error", F.when(F.col("o.cover_letter_uri").isNotNull(), relative_key(F.col("o.cover_letter_uri"), bucket, prefix)["error"]))
    there = objects.filter("kind = 'application'")
    for side, name, contract in (("q", "application_request", "application_request"), ("r", "application_result", "application_result"), ("b", "vacancy_before", "search_item"), ("a", "vacancy_after", "search_item")):
        t = typed(there, name, contract).select(F.regexp_extract("key", r"^(.*)/[^/]+$", 1).alias("_at"), F.struct("v", "violations", "key").alias(side))
        out = out.join(t, "_at", "left")
    return out.drop("_key", "_at")


COUNTERS = ["search_observation_count", "unique_vacancy_count", "candidate_count", "full_fetch_attempted", "full_fetched", "evaluation_candidate_count", "failed", "stopped_on_captcha", "discovered", "prefiltered", "accepted", "submitted", "confirmed"]
ONLY_FULL = ["description", "salary_from", "salary_to", "salary_currency", "remote", "employment_type", "experience", "flags"]
#: The key of each table of current state.
KEYS = {
    "profiles": ["source", "profile_id"], "resumes": ["profile_id", "resume_id"], "vacancies": ["source", "source_entity_id"], "runs": ["run_id"], "observations": ["run_id", "vacancy_id"], "work_items": ["run_id", "vacancy_id", "resume_id"],
    "decisions": ["run_id", "vacancy_id", "stage"], "applications": ["profile_id", "resume_id", "vacancy_id"],
}


def feeds(parts: dict[str, DataFrame], quarantine: DataFrame, base: str, source: str = "board", arrival: str = "") -> dict[str, DataFrame]:
    """Rows of the sound runs for each table of current state, not merged yet, in order of ``seq``: ``arrival``, then date and run. ``base`` is the URI that keys are below."""
    bad = quarantine.select("run_id").distinct()
    seq = F.concat(F.lit(arrival), F.concat_ws("/", F.col("date").cast("string"), "run_id"))

    def sound(name: str) -> DataFrame:
        return merge.whole_runs(parts[name], bad, ["run_id"]).withColumn("seq", seq)

    def uri(key: str) -> Column:
        return F.concat(F.lit(f"{base.rstrip('/')}/"), key)

    heads = sound("heads")
    out = {"profiles": heads.select(F.lit(source).alias("source"), F.col("h.profile_id").alias("profile_id"), F.col("h.account_key").alias("account_key"), "seq")}
    resume = heads.select(F.col("h.profile_id").alias("profile_id"), F.col("h.started_at").alias("first_seen_at"), F.col("h.started_at").alias("last_seen_at"), F.explode(F.when(F.col("version") == 3, F.col("h.resume_ids")).otherwise(F.array("h.resume_id"))).alias("resume_id"), "seq")
    out["resumes"] = resume

    provenance = ["run_id", "vacancy_id", "observed_at", "seq", "key", "sha256"]
    full = sound("vacancy")
    full = full.withColumn("flags", mapping.operational_flags(full, "payload"))
    full = mapping.canonical_posting(full, "payload", source, [*provenance, "flags"]).drop("valid").withColumns({"is_full": F.lit(True), "seq": F.concat("seq", F.lit("/1"))})
    item = sound("search_item")
    partial = mapping.search_item(item.withColumn("_employer", F.col("payload.employer.id")), "payload", [*provenance, "_employer"]).withColumnRenamed("_employer", "company_id").withColumns({"is_full": F.lit(False), "source": F.lit(source), "seq": F.concat("seq", F.lit("/0"))})
    feed = merge.change_feed(full, partial).withColumns({"raw_uri": uri("key"), "content_hash": F.col("sha256"), "first_seen_at": F.col("observed_at"), "last_seen_at": F.col("observed_at")})
    out["vacancies"] = feed

    def end(name: str) -> DataFrame:
        have = set(parts[name].schema["s"].dataType.fieldNames())
        return parts[name].select("run_id", F.try_to_timestamp("s.finished_at").alias("finished_at"), *[(F.col(f"s.{c}") if c in have else F.lit(None)).cast("boolean" if c == "stopped_on_captcha" else "int").alias(c) for c in COUNTERS])

    ends = reduce(DataFrame.unionByName, [end(n) for n in ("summary3", "summary2") if n in parts])
    out["runs"] = heads.join(ends, "run_id", "left").select(
        "run_id", "date", "version", F.when(F.col("finished_at").isNull(), "incomplete").otherwise("finished").alias("status"), "h.*", "finished_at", *COUNTERS, F.concat(F.lit("batches/date="), F.col("date").cast("string"), F.lit("/run_id="), "run_id").alias("s3_prefix"), "seq")
    if "observed" in parts:
        seen = sound("observed")
        out["observations"] = seen.select("run_id", "vacancy_id", "seq", *[F.col(f"o.{c}").alias(c) for c in ("full_fetch_status", "matched_query_keys", "matched_query_sets", "query_page_uris", "search_item_uri", "vacancy_uri", "evaluation_candidates_uri")], F.try_to_timestamp("o.observed_at").alias("observed_at"))
        work = seen.select("run_id", "vacancy_id", "seq", F.try_to_timestamp("e.created_at").alias("created_at"), F.explode("e.evaluations").alias("x"))
        out["work_items"] = work.select("run_id", "vacancy_id", F.col("x.source_resume_id").alias("resume_id"), "seq", *[F.col(f"x.{c}").alias(c) for c in ("binding_key", "target_key", "binding_version", "auto_apply", "matched_query_keys", "matched_query_sets", "resume_query_sets",
                                        "full_fetch_status", "evaluation_status")], F.col("x.provenance_overlap").alias("overlap"), "created_at")
    if "decision" in parts:
        none = F.array().cast("array<string>")
        out["decisions"] = sound("decision").select("run_id", "vacancy_id", F.col("v.stage").alias("stage"), "seq", F.col("v.accepted").alias("accepted"), F.col("v.reason").alias("reason"), F.coalesce("v.matched_domains", none).alias("matched_domains"),
                                                    F.coalesce("v.blocked_terms", none).alias("blocked_terms"), mapping.keep_keys(F.col("rest"), DECISION_METADATA).alias("metadata"), F.try_to_timestamp("v.created_at").alias("created_at"))
        after = F.when(~F.get_json_object("r.v.confirmation_error", "$.stage").eqNullSafe("vacancy_after"), uri("a.key"))
        out["applications"] = sound("applied").select(
            F.col("h.profile_id").alias("profile_id"), F.col("h.resume_id").alias("resume_id"), "vacancy_id", "seq", F.col("o.application_run_id").alias("application_run_id"), F.col("run_id").alias("batch_run_id"), F.col("r.v.submission_mode").alias("submission_mode"),
            F.col("r.v.status").alias("status"), F.col("r.v.confirmed").alias("confirmed"), F.try_to_timestamp("q.v.requested_at").alias("requested_at"), F.try_to_timestamp("r.v.finished_at").alias("finished_at"), F.col("o.cover_letter_uri").alias("cover_letter_uri"),
            uri("q.key").alias("request_uri"), uri("r.key").alias("result_uri"), uri("b.key").alias("before_uri"), after.alias("after_uri"), F.struct("r.v.relations", "r.v.claim_status", "r.v.confirmation_evidence", "r.v.confirmation_error").alias("upstream"))
    return out


def merged(name: str, feed: DataFrame) -> DataFrame:
    """One row per key of the table from its feed. The result, as a feed with an empty ``seq``, stands for all that it was made from: see ``as_feed``."""
    key = KEYS[name]
    if name == "profiles":
        return feed.groupBy(*key).agg(F.max_by(F.when(F.col("account_key").isNotNull(), F.col("account_key")), F.when(F.col("account_key").isNotNull(), F.col("seq"))).alias("account_key"))
    if name == "resumes":
        return feed.groupBy(*key).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    if name == "vacancies":
        return merge.coalesce_merge(feed, key, "observed_at", "seq", ["title", "company_name", "company_id", "area_name", "url", "published_at"], ["raw_uri", "content_hash"], ONLY_FULL, "is_full",
                                    {"first_seen_at": "first_seen_at"}, {"last_seen_at": "last_seen_at"}, chunk=F.substring_index("seq", "/", 1))
    if name == "applications":
        return merge.newest(feed, key, ["requested_at", "seq"]).drop("seq")
    return merge.last_write(feed, key).drop("seq")


def as_feed(name: str, state: DataFrame) -> DataFrame:
    """Merged rows as the first rows of a feed: older than any arrival, whole, as new as the newest row that they were made from."""
    state = state.withColumn("seq", F.lit(""))
    return state.withColumns({"observed_at": F.col("last_seen_at"), "is_full": F.lit(True)}) if name == "vacancies" else state


def current_state(parts: dict[str, DataFrame], quarantine: DataFrame, base: str, source: str = "board") -> dict[str, DataFrame]:
    """Tables of current state from the sound runs: profiles, resumes, vacancies, runs, observations, work_items, decisions, applications. ``base`` is the URI that keys are below."""
    return {n: merged(n, f) for n, f in feeds(parts, quarantine, base, source).items()}


def run_log(objects: DataFrame, parts: dict[str, DataFrame], quarantine: DataFrame) -> DataFrame:
    """One row per discovered run: date, version, verdict (loaded, failed or no_header), complete, candidates, work_items, decisions, applications; the counts are 0 where nothing was loaded."""
    failed = quarantine.select("run_id").distinct().withColumn("_failed", F.lit(True))
    out = discover_runs(objects).select("run_id", "date", F.col("has_summary").alias("complete")).join(parts["heads"].groupBy("run_id").agg(F.max("version").alias("version")), "run_id", "left").join(failed, "run_id", "left")
    for name, part, n in (("candidates", "keys", F.count("*")), ("work_items", "observed", F.sum(F.size("e.evaluations"))), ("decisions", "decision", F.count("*")), ("applications", "applied", F.count("*"))):
        out = out.join(parts[part].groupBy("run_id").agg(n.alias(f"_{name}")), "run_id", "left") if part in parts else out.withColumn(f"_{name}", F.lit(0).cast("long"))
    verdict = F.when(F.col("_failed"), "failed").when(F.col("version").isNull(), "no_header").otherwise("loaded")
    out = out.withColumn("verdict", verdict)
    return out.select("run_id", "date", "version", "verdict", "complete", *[F.when(F.col("verdict") == "loaded", F.coalesce(f"_{n}", F.lit(0))).otherwise(0).alias(n) for n in ("candidates", "work_items", "decisions", "applications")])


def backfill(objects: DataFrame, out: str, bucket: str, prefix: str, source: str = "board") -> None:
    """Writes quarantine, run log and current state of the whole tree below ``out``; the same tree gives the same tables.

    Typed parts are stored once by kind, below ``out``/_parts. ``streaming.state_tables`` merges new runs only, into a state that changes at once.
    """
    parts, quarantine = store_parts(*parse(objects, bucket, prefix), f"{out}/_parts")
    tables = current_state(parts, quarantine, f"s3://{bucket}/{prefix}", source) | {"run_log": run_log(objects, parts, quarantine), "quarantine": quarantine}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda t: t[1].write.mode("overwrite").parquet(f"{out}/{t[0]}"), tables.items()))
