"""Accounts, bindings, résumé inventories and skip lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enabled(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("enabled", F.lit(False)))


def account_facts(accounts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per enabled account: the ordered union of query sets of its enabled bindings, and whether its runs can use up its daily cap.

    accounts(account_key, enabled, apply_runs_per_day, max_apply_per_run,
    apply_daily_cap); bindings(account_key, binding_pos, enabled, query_sets).
    """
    first = enabled(bindings).select("account_key", "binding_pos", F.posexplode("query_sets").alias("_i", "_s")).groupBy("account_key", "_s").agg(F.min(F.struct("binding_pos", "_i")).alias("_p"))
    b = first.groupBy("account_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda x: x["_s"]).alias("query_sets"))
    a = enabled(accounts).join(b, "account_key", "left")
    return a.withColumn("query_sets", F.coalesce("query_sets", F.array().cast("array<string>"))).withColumn("cap_reachable", F.col("apply_runs_per_day") * F.col("max_apply_per_run") >= F.col("apply_daily_cap"))


def enabled_queries(catalogue: DataFrame, set_key: str = "query_set_key") -> DataFrame:
    return catalogue.groupBy(set_key).agg(F.count_if("enabled").alias("enabled_queries"), F.count("*").alias("queries"))


def key_sound(kind: str, c: Column) -> Column:
    """Form of account, query and set keys: lower-case letters, digits, underscores; queries may hold dashes and dots."""
    return c.rlike({"account": "^[a-z][a-z0-9_]*$", "query_set": "^[a-z][a-z0-9_]*$", "query": "^[a-z0-9][a-z0-9_.-]*$"}[kind])


def inventory(resumes: DataFrame, profiles: DataFrame, account: str) -> DataFrame:
    """Résumés of one account with their profile, by identifier; ``reconciled_at`` is the newest time that any was seen or lost."""
    p = profiles.filter(F.col("account_key") == account)
    j = resumes.join(p.select("profile_key", "account_key"), "profile_key")
    newest = j.agg(F.max(F.coalesce("inactive_at", "last_seen_at")).alias("reconciled_at"))
    return j.join(F.broadcast(newest)).orderBy("source_resume_id")  # newest is one row


def claimable(requests: DataFrame, resumes: DataFrame) -> DataFrame:
    """Requests whose résumé exists, is active and present."""
    return requests.join(resumes.filter("lifecycle = 'active' and present").select("profile_key", "source_resume_id").distinct(), ["profile_key", "source_resume_id"], "left_semi")


def identities(applications: DataFrame, profiles: DataFrame, resumes: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Applications whose profile, résumé and vacancy are all known by natural keys, with the row identifiers of these: profile_row, resume_row, vacancy_row.

    profiles(source, profile_key, profile_row), resumes(profile_key,
    source_resume_id, resume_row), vacancies(source, source_entity_id, vacancy_row), each key once.
    """
    known = applications.join(profiles.select("source", "profile_key", "profile_row"), ["source", "profile_key"])
    known = known.join(resumes.select("profile_key", "source_resume_id", "resume_row"), ["profile_key", "source_resume_id"])
    return known.join(vacancies.select("source", F.col("source_entity_id").alias("vacancy_id"), "vacancy_row"), ["source", "vacancy_id"])


def reply_queue(negotiations: DataFrame, blacklist: DataFrame, now: Column, days: int, only_invited: bool) -> DataFrame:
    """Negotiations to answer: with a résumé, recent, not discarded, employer not blacklisted; invited ones only if asked."""
    recent = F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= days * 86400
    df = negotiations.filter(F.col("resume_id").isNotNull() & recent & (F.col("state") != "discard"))
    if only_invited:
        df = df.filter(F.col("state").startswith("inv"))
    return df.join(blacklist.select("employer_id").distinct(), "employer_id", "left_anti")


def purge_skipped(skipped: DataFrame, reason: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number that goes): of one reason, or all."""
    goes = F.lit(True) if reason is None else F.coalesce(F.col("reason") == reason, F.lit(False))
    return skipped.filter(~goes), skipped.agg(F.count_if(goes).alias("purged"))
