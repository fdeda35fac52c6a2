"""Typed contracts of wire objects: one schema and rule set each, and their check.

A contract never raises: objects that break it become quarantine rows with a
rule id. Strict contracts forbid unknown keys; open ones keep them in ``rest``.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BINDING = "struct<source_resume_id:string,binding_key:string,target_key:string,binding_version:int,query_sets:array<string>,auto_apply:boolean>"
ROTATION = "query_catalog_size int, query_catalog_signature string, query_cursor_start int, query_cursor_next int, query_rotation_wrapped boolean"
EVALUATION = (
    "struct<event_type:string,schema_version:int,account_key:string,source_profile:string,source_resume_id:string,vacancy_id:string,"
    "duplicate_key:struct<account_key:string,source_profile:string,source_resume_id:string,vacancy_id:string>,binding_key:string,target_key:string,binding_version:int,auto_apply:boolean,"
    "matched_query_keys:array<string>,matched_query_sets:array<string>,resume_query_sets:array<string>,"
    "provenance_overlap:struct<has_overlap:boolean,matched_query_keys:array<string>,matched_query_sets:array<string>>,full_fetch_status:string,evaluation_status:string>"
)


@dataclass(frozen=True)
class Contract:
    ddl: str
    required: tuple[str, ...]
    strict: bool = True
    #: Rule id to SQL condition over ``v``, the parsed object; null counts as broken.
    rules: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


ZONED = r"(Z|z|[+-][0-9]{2}:?[0-9]{2})$"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def zoned(name: str) -> str:
    return f"v.{name} rlike '{ZONED}' and try_to_timestamp(v.{name}) is not null"


def at_least_zero(*names: str) -> str:
    return " and ".join(f"coalesce(v.{n}, 0) >= 0" for n in names)


_OBSERVE = "event_type string, schema_version int, run_id string, runtime_mode string, account_key string, profile_id string"
_ROTATION_RULES = {
    "rotation_offsets": "v.query_catalog_size > 0 and v.query_cursor_start between 0 and v.query_catalog_size - 1 and v.query_cursor_next between 0 and v.query_catalog_size - 1",
    "signature_hex": "v.query_catalog_signature rlike '^[0-9a-f]{64}$'",
}

# Fields and literals of the wire objects.
CONTRACTS: dict[str, Contract] = {
    "observe_run": Contract(
        f"{_OBSERVE}, enabled_resume_keys array<string>, source_resume_ids array<string>, target_keys array<string>, active_bindings array<{BINDING}>, query_set_keys array<string>, query_keys array<string>,"
        f" {ROTATION}, max_queries_per_run int, discovery_config_version int, area int, period int, pages int, per_page int, max_unique_vacancies_per_run int, max_full_fetch_per_run int,"
        " search_query_delay_seconds double, full_fetch_min_delay_seconds double, full_fetch_max_delay_seconds double, started_at string, external_writes_allowed boolean",
        ("event_type", "schema_version", "run_id", "runtime_mode", "account_key", "active_bindings", "query_keys", "started_at"),
        rules=_ROTATION_RULES | {
            "version": "v.schema_version = 3", "mode": "v.runtime_mode = 'observe'", "run_id_uuid": f"v.run_id rlike '{UUID}'", "started_zoned": zoned("started_at"), "no_external_writes": "v.external_writes_allowed = false",
            "resume_ids_match_bindings": "v.source_resume_ids = transform(v.active_bindings, b -> b.source_resume_id)", "targets_match_bindings": "v.target_keys = transform(v.active_bindings, b -> b.target_key)",
            "resume_ids_unique": "size(array_distinct(v.source_resume_ids)) = size(v.source_resume_ids)", "query_keys_unique": "size(array_distinct(v.query_keys)) = size(v.query_keys)",
            "binding_sets_known": "forall(v.active_bindings, b -> size(array_except(b.query_sets, v.query_set_keys)) = 0)", "binding_version": "forall(v.active_bindings, b -> b.binding_version >= 1)",
            "window_size": "size(v.query_keys) = least(v.max_queries_per_run, v.query_catalog_size)", "window_next": "v.query_cursor_next = (v.query_cursor_start + size(v.query_keys)) % v.query_catalog_size",
            "window_wrapped": "v.query_rotation_wrapped = (v.query_cursor_start + size(v.query_keys) >= v.query_catalog_size)", "delay_range": "v.full_fetch_min_delay_seconds <= v.full_fetch_max_delay_seconds",
        }),
    "observe_summary": Contract(
        f"{_OBSERVE}, queries_executed int, queries_selected int, {ROTATION}, search_observation_count int, unique_vacancy_count int, candidate_count int, full_fetch_attempted int, full_fetched int,"
        " evaluation_candidate_count int, submitted int, confirmed int, external_writes_attempted int, failed int, stopped_on_captcha boolean, reasons map<string,int>, finished_at string, s3_prefix string",
        ("event_type", "schema_version", "run_id", "finished_at", "candidate_count", "evaluation_candidate_count"),
        rules=_ROTATION_RULES | {
            "version": "v.schema_version = 3", "finished_zoned": zoned("finished_at"), "no_external_writes": "coalesce(v.submitted, 0) = 0 and coalesce(v.confirmed, 0) = 0 and coalesce(v.external_writes_attempted, 0) = 0",
            "counters": at_least_zero("queries_executed", "queries_selected", "search_observation_count", "unique_vacancy_count", "candidate_count", "full_fetch_attempted", "full_fetched", "failed")}),
    "observation": Contract(
        f"{_OBSERVE}, vacancy_id string, candidate_resume_keys array<string>, candidate_source_resume_ids array<string>, candidate_target_keys array<string>,"
        " candidate_bindings array<struct<source_resume_id:string,binding_key:string,target_key:string,binding_version:int,auto_apply:boolean>>, evaluation_candidate_count int, evaluation_candidates_uri string,"
        " matched_query_keys array<string>, matched_query_sets array<string>, query_page_uris array<string>, search_item_uri string, vacancy_uri string, full_fetch_status string, full_fetch_error map<string,string>, observed_at string",
        ("event_type", "schema_version", "run_id", "vacancy_id", "full_fetch_status", "observed_at"),
        rules={"version": "v.schema_version = 3", "observed_zoned": zoned("observed_at"), "count_matches": "v.evaluation_candidate_count = size(v.candidate_source_resume_ids)"}),
    "evaluation_candidates": Contract(
        f"event_type string, schema_version int, run_id string, runtime_mode string, account_key string, source_profile string, vacancy_id string, evaluation_semantics string, evaluations array<{EVALUATION}>, created_at string",
        ("event_type", "schema_version", "run_id", "account_key", "source_profile", "vacancy_id", "evaluations", "created_at"),
        rules={"version": "v.schema_version = 1", "semantics": "v.evaluation_semantics = 'routing_only_no_relevance_decision'", "created_zoned": zoned("created_at"), "same_vacancy": "forall(v.evaluations, e -> e.vacancy_id = v.vacancy_id)",
               "resumes_unique": "size(array_distinct(transform(v.evaluations, e -> e.source_resume_id))) = size(v.evaluations)",
               "work_item_form": "forall(v.evaluations, e -> e.schema_version = 1 and e.binding_version >= 1 and e.evaluation_status = 'pending_filtering_v2')"}),
    "apply_run": Contract(
        "event_type string, schema_version int, run_id string, profile_id string, resume_id string, search string, area int, period int, pages int, per_page int, professional_roles array<int>, max_responses int,"
        " cover_letter_mode string, live boolean, runtime_mode string, account_key string, resume_key string, target_key string, binding_version int, query_sets array<string>, external_writes_allowed boolean, started_at string",
        ("event_type", "schema_version", "run_id", "profile_id", "resume_id", "live", "started_at"),
        rules={"binding_version": "v.binding_version is null or v.binding_version >= 1", "version": "v.schema_version = 2", "run_id_uuid": f"v.run_id rlike '{UUID}'", "started_zoned": zoned("started_at")}),
    "apply_summary": Contract(
        "event_type string, schema_version int, run_id string, live boolean, discovered int, prefiltered int, full_fetched int, accepted int, submitted int, confirmed int, failed int, external_writes_attempted int,"
        " quota_consumed int, stopped_on_captcha boolean, reasons map<string,int>, finished_at string, s3_prefix string",
        ("run_id", "finished_at"),
        rules={"finished_zoned": zoned("finished_at"), "counters": at_least_zero("discovered", "prefiltered", "full_fetched", "accepted", "submitted", "confirmed", "failed")}),
    "decision": Contract(
        "event_type string, schema_version int, run_id string, vacancy_id string, stage string, reason string, accepted boolean, matched_domains array<string>, blocked_terms array<string>, created_at string",
        ("run_id", "vacancy_id", "stage", "reason", "accepted", "created_at"), strict=False, rules={"created_zoned": zoned("created_at")}),
    "outcome": Contract(
        "event_type string, schema_version int, run_id string, vacancy_id string, status string, confirmed boolean, submission_mode string, application_run_id string, application_result_uri string, cover_letter_uri string,"
        " reason string, error_type string, error string, external_write_attempted boolean, created_at string",
        ("run_id", "vacancy_id", "status", "created_at"),
        rules={"created_zoned": zoned("created_at")}),
    "application_request": Contract(
        "event_type string, schema_version int, run_id string, account_key string, profile_id string, resume_id string, vacancy_id string, submission_mode string, requested_at string",
        ("run_id", "profile_id", "resume_id", "vacancy_id", "submission_mode", "requested_at"), strict=False, rules={"requested_zoned": zoned("requested_at")}),
    "application_result": Contract(
        "event_type string, schema_version int, run_id string, account_key string, profile_id string, resume_id string, vacancy_id string, submission_mode string, status string, confirmed boolean, claim_status string, confirmation_evidence string,"
        " confirmation_error string, relations array<string>, finished_at string",
        ("run_id", "profile_id", "resume_id", "vacancy_id", "status", "finished_at"), strict=False, rules={"finished_zoned": zoned("finished_at")}),
    "vacancy": Contract("id string, name string", ("id", "name"), strict=False),
    "search_item": Contract("id string, name string", ("id",), strict=False),
    "discovery": Contract(
        f"event_type string, schema_version int, run_id string, account_key string, queries_executed int, max_queries_per_run int, {ROTATION}, query_sets array<string>, query_pages array<struct<query_key:string,query_set:string,page:int,uri:string>>,"
        " query_errors array<struct<query_key:string,error_type:string,error:string,reason:string>>, search_observation_count int, unique_vacancy_count int, selected_candidate_count int, truncated_by_max_unique boolean,"
        " vacancies array<struct<vacancy_id:string,matched_query_keys:array<string>,matched_query_sets:array<string>,query_page_uris:array<string>>>, created_at string",
        ("event_type", "schema_version", "run_id", "account_key", "query_pages", "query_errors", "vacancies", "created_at"),
        rules={"version": "v.schema_version = 3", "created_zoned": zoned("created_at"), "vacancies_unique": "size(array_distinct(transform(v.vacancies, x -> x.vacancy_id))) = size(v.vacancies)",
               "selected": "v.selected_candidate_count <= v.unique_vacancy_count and v.unique_vacancy_count = size(v.vacancies)", "counters": at_least_zero("queries_executed", "search_observation_count", "unique_vacancy_count", "selected_candidate_count")}),
    "resume_reconciliation": Contract(
        "event_type string, schema_version int, account_key string, source_profile string, reconciled_at string, registered_ids array<string>, updated_ids array<string>, reactivated_ids array<string>, deleted_ids array<string>,"
        " resumes array<struct<source_resume_id:string,current_title:string,upstream_status:string,lifecycle:string,content_sha256:string,binding_key:string,binding_enabled:boolean,target_key:string,query_sets:array<string>,"
        "auto_apply:boolean,selectable_for_evaluation:boolean,selectable_for_auto_apply:boolean,binding_version:int>>",
        ("event_type", "schema_version", "account_key", "source_profile", "reconciled_at", "registered_ids", "updated_ids", "reactivated_ids", "deleted_ids", "resumes"),
        rules={"version": "v.schema_version = 1", "reconciled_zoned": zoned("reconciled_at"), "ids_sorted": "forall(array(v.registered_ids, v.updated_ids, v.reactivated_ids, v.deleted_ids), x -> x = array_sort(array_distinct(x)))",
               "resumes_unique": "size(array_distinct(transform(v.resumes, r -> r.source_resume_id))) = size(v.resumes)", "lifecycle": "forall(v.resumes, r -> r.lifecycle in ('active', 'deleted'))",
               "ids_known": "size(array_except(concat(v.registered_ids, v.updated_ids, v.reactivated_ids, v.deleted_ids), transform(v.resumes, r -> r.source_resume_id))) = 0",
               "deleted_gone": "size(array_intersect(v.deleted_ids, transform(filter(v.resumes, r -> r.lifecycle <> 'deleted'), r -> r.source_resume_id))) = 0",
               "gone_not_selectable": "forall(v.resumes, r -> r.lifecycle = 'active' or not (r.binding_enabled or r.auto_apply))", "sha_hex": "forall(v.resumes, r -> r.content_sha256 rlike '^[0-9a-f]{64}$')"}),
    "resume_inventory": Contract("account_key string, items array<struct<id:string,title:string,status:string>>, observed_at string", ("account_key", "items", "observed_at"), strict=False, rules={
        "ids_unique": "size(array_distinct(transform(v.items, i -> i.id))) = size(v.items)", "ids_present": "forall(v.items, i -> i.id is not null)", "observed_zoned": zoned("observed_at")}),
    "dispatch": Contract("account_key string, run_number int, status string, reason string, submitted int, confirmed int, quota_consumed int, at string", ("account_key", "status", "at"), rules={"at_zoned": zoned("at")}),
}

# Event type (after the board's prefix) and schema version of the objects.
EVENTS: dict[str, tuple[tuple[str, ...], int]] = {
    "observe_run": (("batch.started",), 3), "observe_summary": (("batch.finished",), 3), "observation": (("vacancy.observed",), 3), "evaluation_candidates": (("vacancy_resume.evaluation_candidates",), 1),
    "apply_run": (("batch.started",), 2), "apply_summary": (("batch.finished",), 2), "decision": (("vacancy.decision",), 2), "outcome": (("batch.application_completed", "batch.application_failed"), 2),
    "discovery": (("batch.discovery",), 3), "resume_reconciliation": (("account.resumes.reconciled",), 1),
    "application_request": (("application.requested",), 2), "application_result": (("application.submitted",), 2),
}


def check(df: DataFrame, contract: Contract, body: str = "body", out: str = "v") -> DataFrame:
    """df with the parsed object ``out`` and ``violations``: rule ids, empty for a sound object."""
    text = F.col(body).cast("string")
    df = df.withColumn("_text", text).withColumn(out, F.from_json("_text", contract.schema)).withColumn("_keys", F.json_object_keys("_text"))
    names = contract.schema.fieldNames()
    here = F.col(out)
    not_object = F.col("_keys").isNull()
    found: list[Column] = [F.when(not_object, "not_a_json_object")]
    if contract.strict:
        found.append(F.when(F.size(F.array_except("_keys", F.array(*map(F.lit, names)))) > 0, "unknown_keys"))
    found += [F.when(~not_object & here[n].isNull(), f"{n}_missing") for n in contract.required]
    found += [F.when(~not_object & here[n].isNull() & F.get_json_object("_text", f"$.{n}").isNotNull(), f"{n}_type") for n in names if n not in contract.required]
    sql = {k: c.replace("v.", f"`{out}`.") for k, c in contract.rules.items()}
    found += [F.when(~not_object & ~F.coalesce(F.expr(c), F.lit(False)), k) for k, c in sql.items()]
    df = df.withColumn("violations", F.filter(F.array(*found), lambda x: x.isNotNull()))
    if not contract.strict:
        rest = F.map_filter(F.from_json("_text", "map<string,string>"), lambda k, v: ~k.isin(*names))
        df = df.withColumn("rest", F.to_json(rest))
    return df.drop("_text", "_keys")


def split(checked: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantine: one row per broken rule)."""
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.select(*keep, F.explode("violations").alias("rule"))
