"""Posting rules: tags, the title cascade, the two gates and their log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmill.functions import lexicons as L
from jobmill.functions.text import strip_tags, tags

DECISION = "struct<accepted:boolean,reason:string,matched_domains:array<string>,blocked_terms:array<string>>"


def _decision(accepted: bool, reason: Column | str, domains: Column | None = None, blocked: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(accepted).alias("accepted"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (none if domains is None else domains).alias("matched_domains"), (none if blocked is None else blocked).alias("blocked_terms"),
    )


def title_decision(df: DataFrame, title: str, rules: L.Rules = L.POSTING_RULES, out: str = "decision") -> DataFrame:
    """df with a decision over the title; the first failing rule gives the reason. A null title is missing."""
    t = F.trim(F.coalesce(F.col(title), F.lit("")))
    df = df.withColumns({"_d": tags(t, rules.domains), "_c": tags(t, rules.contexts), "_r": tags(t, rules.roles)})
    d, c, r = F.col("_d"), F.col("_c"), F.col("_r")
    case = F.when(t == "", _decision(False, "missing_title")).when(F.size(d) == 0, _decision(False, "title_out_of_scope"))
    case = case.when(F.size(c) > 0, _decision(False, "excluded_context", d, c)).when(F.size(r) > 0, _decision(False, "title_contains_unrelated_role", d, r))
    if rules.unless:
        tag, pattern, saves = rules.unless
        case = case.when(t.rlike(L.compiled(pattern)) & ~F.array_contains(d, saves), _decision(False, rules.reasons.get("unless", f"{tag}_without_{saves}"), d, F.array(F.lit(tag))))
    if rules.alone:
        domain, pattern, reason = rules.alone
        case = case.when((d == F.array(F.lit(domain))) & ~t.rlike(L.compiled(pattern)), _decision(False, reason, d))
    return df.withColumn(out, case.otherwise(_decision(True, "accepted", d))).drop("_d", "_c", "_r")


def search_gate(df: DataFrame, title: str, archived: Column, rules: L.Rules = L.POSTING_RULES, out: str = "decision") -> DataFrame:
    """Title cascade, then archived postings rejected."""
    df = title_decision(df, title, rules, out)
    d = F.col(out)
    return df.withColumn(out, F.when(d["accepted"] & F.coalesce(archived, F.lit(False)), _decision(False, "archived", d["matched_domains"])).otherwise(d))


def area_id(c: Column) -> Column:
    return c.try_cast("int")


def full_context(*parts: Column) -> Column:
    """Parts one a line, absent ones empty."""
    return F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def full_gate(
    df: DataFrame, title: str, context: Column, archived: Column, closed: Column, response_url: Column, area: Column,
    required_area: int | None = 1, rules: L.Rules = L.POSTING_RULES, out: str = "decision",
) -> DataFrame:
    """Title cascade, context of the full text, archived, closed, external URL, area. An unknown area passes."""
    df = title_decision(df, title, rules, out).withColumn("_c", tags(context, rules.contexts))
    d, dom, c = F.col(out), F.col(out)["matched_domains"], F.col("_c")
    case = F.when(~d["accepted"], d).when(F.size(c) > 0, _decision(False, "excluded_context", dom, c))
    case = case.when(F.coalesce(archived, F.lit(False)), _decision(False, "archived", dom))
    case = case.when(F.coalesce(closed, F.lit(False)), _decision(False, "closed_for_applicants", dom))
    case = case.when(F.coalesce(response_url, F.lit("")) != "", _decision(False, "external_response_url", dom))
    if required_area is not None:
        case = case.when(area.isNotNull() & (area != required_area), _decision(False, F.concat(F.lit("area_"), area.cast("string"), F.lit("_not_allowed")), dom))
    return df.withColumn(out, case.otherwise(d)).drop("_c")


def two_stage_log(gated: DataFrame, keys: list[str], searched: str = "searched", validated: str = "decision") -> DataFrame:
    """One row per decision of rows that hold both: a rejected search item with a ``prefilter_`` reason, or what the full gate said of it. One scan, no join."""
    s, d = F.col(searched), F.col(validated)
    first, second = ([F.lit(stage).alias("stage"), reason.alias("reason"), c["accepted"].alias("accepted")] for stage, reason, c in (("prefilter", F.concat(F.lit("prefilter_"), s["reason"]), s), ("full_validation", d["reason"], d)))
    return gated.select(*keys, F.when(~s["accepted"], F.struct(*first)).otherwise(F.struct(*second)).alias("_x")).select(*keys, "_x.*")


def excluded_by_pattern(title: Column, snippet: Column, description: Column, pattern: str) -> Column:
    """Whether the user's pattern occurs in title and snippet, or in the description without tags."""
    short = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    return short.rlike(L.compiled(pattern)) | F.coalesce(strip_tags(description), F.lit("")).rlike(L.compiled(pattern))


def apply_eligibility(relations: Column, archived: Column, has_test: Column, response_url: Column, skip_tests: bool) -> Column:
    """struct(eligible, reason, rejected): any relation blocks here."""
    no = F.coalesce(F.size(relations), F.lit(0)) > 0
    reason = F.when(no, "relations").when(F.coalesce(archived, F.lit(False)), "archived")
    if skip_tests:
        reason = reason.when(F.coalesce(has_test, F.lit(False)), "has_test")
    reason = reason.when(F.coalesce(response_url, F.lit("")) != "", "redirect")
    return F.struct(reason.isNull().alias("eligible"), reason.alias("reason"), F.coalesce(F.array_contains(relations, "got_rejection"), F.lit(False)).alias("rejected"))


def submission_blockers(expected_id: Column, actual_id: Column, archived: Column, closed: Column, response_url: Column) -> Column:
    """Names of what stops a submission, in order."""
    found = F.array(
        F.when(~expected_id.eqNullSafe(actual_id), "id_mismatch"), F.when(archived, "archived"), F.when(closed, "closed_for_applicants"),
        F.when(F.coalesce(response_url, F.lit("")) != "", "external_response_url"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def published(status: Column) -> Column:
    return F.coalesce(status == "published", F.lit(False))


def selectable(active: Column, enabled: Column, bound: Column, targeted: Column) -> Column:
    """Whether a résumé may be evaluated."""
    return F.coalesce(active & enabled & bound & targeted, F.lit(False))


def selectable_for_action(can_evaluate: Column, auto: Column, status: Column) -> Column:
    return can_evaluate & F.coalesce(auto, F.lit(False)) & published(status)


def stale(updated_at: Column, state: Column, now: Column, older_than_days: int | None) -> Column:
    """Older than n whole days; without n, discarded ones."""
    if older_than_days is None:
        return state == "discard"
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(updated_at)) / 86400) > older_than_days


def instant_answer(created_at: Column, answered_at: Column, seconds: int = 960, ignore_days: bool = False) -> Column:
    """Answered within so many seconds. ``ignore_days`` drops whole days first, an old rule."""
    gap = F.unix_timestamp(answered_at) - F.unix_timestamp(created_at)
    return F.pmod(gap, F.lit(86400)) <= seconds if ignore_days else gap.between(0, seconds)


def needs_reply(last_author: Column, viewed: Column) -> Column:
    """The employer spoke last, or has not yet looked."""
    return (last_author == "employer") | ~F.coalesce(viewed, F.lit(False))


def find(df: DataFrame, newest: str, **conditions: object) -> DataFrame:
    """Rows that meet all conditions, newest first. ``column__op=value`` with op of eq, ne, lt, le, gt, ge, like, is, is_not, in, not_in; a bare name is eq."""
    ops = {
        "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
        "like": lambda c, v: c.like(v), "is": lambda c, v: c.eqNullSafe(v), "is_not": lambda c, v: ~c.eqNullSafe(v), "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v),
    }
    for name, value in conditions.items():
        column, _, op = name.partition("__")
        if (op or "eq") not in ops:
            raise ValueError(f"unknown operator {op}")
        df = df.filter(ops[op or "eq"](F.col(column), value))
    return df.orderBy(F.desc(newest))
