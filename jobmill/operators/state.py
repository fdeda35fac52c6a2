"""Keyed state over ordered requests: claims, cursors, quotas, slots."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a claim, and the states from which its owner may move it there.
STATES = ("CLAIMED", "SUBMITTING", "SUBMITTED", "UNCERTAIN", "FAILED_SAFE_TO_RETRY")
MOVES = {"SUBMITTING": ("CLAIMED",), "SUBMITTED": ("CLAIMED", "SUBMITTING"), "UNCERTAIN": ("CLAIMED", "SUBMITTING"), "FAILED_SAFE_TO_RETRY": ("CLAIMED",)}
#: States that end an attempt.
ENDS = ("SUBMITTED", "UNCERTAIN", "FAILED_SAFE_TO_RETRY")
#: Positions that are numbered in one group.
RANGE = 1 << 16
REQUEST = ("seq", "run_id", "account_key", "kind", "at", "error_type", "error_message", "evidence")
CLAIM = "account_key string, run_id string, status string, attempt_count int, claimed_at timestamp, changed_at timestamp, submitted_at timestamp, finished_at timestamp, error_type string, error_message string, evidence string"
CLAIM_COLUMNS = [c.split()[0] for c in CLAIM.split(", ")]
DECISION = f"seq long, by_run_id string, kind string, granted boolean, reason string, {CLAIM}"


def apply_request(claim: dict | None, r: dict) -> tuple[dict | None, str | None]:
    """The claim after a request (REQUEST), and why it was refused, null if it was granted.

    ``acquire`` takes a free claim, or one that failed safely, with one more
    attempt, and clears what the last attempt left. Any other kind is a move: only by the owner,
    only from where it may start; error and evidence are those of the move.
    """
    if r["kind"] == "acquire":
        if not (r["account_key"] or "").strip():
            return claim, "no_account"
        if claim is not None and claim["status"] != "FAILED_SAFE_TO_RETRY":
            return claim, "held"
        return dict(zip(CLAIM_COLUMNS, (r["account_key"].strip(), r["run_id"], "CLAIMED", (claim["attempt_count"] if claim else 0) + 1, r["at"], r["at"], None, None, None, None, "{}"), strict=True)), None
    if r["kind"] not in MOVES:
        return claim, "unknown_state"
    if claim is None:
        return claim, "not_claimed"
    if claim["run_id"] != r["run_id"]:
        return claim, "other_owner"
    if claim["status"] not in MOVES[r["kind"]]:
        return claim, f"not_from_{claim['status']}"
    return claim | {
        "status": r["kind"], "changed_at": r["at"], "submitted_at": r["at"] if r["kind"] == "SUBMITTED" else claim["submitted_at"], "finished_at": r["at"] if r["kind"] in ENDS else None,
        "error_type": r["error_type"], "error_message": r["error_message"], "evidence": r["evidence"] or "{}"}, None


def decide(claim: dict | None, r: dict) -> tuple[dict | None, list]:
    """The claim after a request, and the row of DECISION that tells of it."""
    claim, reason = apply_request(claim, r)
    return claim, [r["seq"], r["run_id"], r["kind"], reason is None, reason, *((claim or {}).get(c) for c in CLAIM_COLUMNS)]


def plain(value):
    """A value of a pandas row as Python has it: no NaN, NaT or Timestamp."""
    if value is None or value is pd.NaT or value != value:
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


def as_requests(requests: DataFrame, key: list[str]) -> DataFrame:
    """key and REQUEST, columns that are not there as nulls; rows without a key ask for nothing."""
    kinds = {"seq": "long", "at": "timestamp"}
    return requests.select(*key, *[(F.col(c) if c in requests.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in REQUEST]).filter(F.col(key[0]).isNotNull())


def decide_claims(requests: DataFrame, key: list[str]) -> DataFrame:
    """requests(key, REQUEST) in order of seq: one row per request, granted or refused and why, with the claim after it.

    Rows arrive sorted within their partition and are folded one after the
    other, so a key with very many requests needs no more memory than others.
    """
    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in key)
    names = [*key, *(c.split()[0] for c in DECISION.split(", "))]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, claim = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                k = r[: len(key)]
                if k != last:
                    last, claim = k, None
                claim, row = decide(claim, dict(zip(REQUEST, map(plain, r[len(key) :]), strict=True)))
                out.append([*k, *row])
            if out:
                yield pd.DataFrame(out, columns=names).astype({"attempt_count": "Int32"})

    return as_requests(requests, key).repartition(*key).sortWithinPartitions(*key, "seq").mapInPandas(fold, f"{kinds}, {DECISION}")


def claims_after(decisions: DataFrame, key: list[str]) -> DataFrame:
    """The claim of each key after its last request, with how many were granted and refused; keys that never held one are absent."""
    g = decisions.groupBy(*key).agg(F.max_by(F.struct(*CLAIM_COLUMNS), "seq").alias("c"), F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))
    return g.filter("c.status is not null").select(*key, "c.*", "granted", "refused")


def refusals(decisions: DataFrame, key: list[str]) -> DataFrame:
    """Requests that changed nothing: who asked for what, why not, and the claim that stood."""
    return decisions.filter(~F.col("granted")).select(*key, "seq", "by_run_id", "kind", "reason", F.col("run_id").alias("held_by"), "status")


def fold_claims(requests: DataFrame, key: list[str]) -> DataFrame:
    return claims_after(decide_claims(requests, key), key)


def reserve_windows(requests: DataFrame, profile: list[str], seq: str, signature: str, size: str, window: str) -> DataFrame:
    """Start and next offset of each reservation in a circular catalogue; a changed signature or size starts again at 0."""
    w = Window.partitionBy(*profile).orderBy(seq)
    changed = ~(F.lag(signature).over(w).eqNullSafe(F.col(signature)) & F.lag(size).over(w).eqNullSafe(F.col(size)))
    df = requests.withColumn("epoch", F.sum(F.when(changed, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*profile, "epoch").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    step = F.least(F.col(window), F.col(size))
    start = F.pmod(F.coalesce(F.sum(step).over(inside), F.lit(0)), F.col(size))
    return df.withColumn("start_offset", start).withColumns({"next_offset": F.pmod(start + step, F.col(size)), "wrapped": start + step >= F.col(size)})


def allocate_quota(rows: DataFrame, account: list[str], pos: str, consumed: str, quota: Column) -> DataFrame:
    """What is left of the quota before each row in order; rows that find none left are not allowed."""
    w = Window.partitionBy(*account).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum(consumed).over(w), F.lit(0))
    return rows.withColumn("available", F.greatest(quota - prior, F.lit(0))).withColumn("allowed", F.col("available") > 0)


def interleave(accounts: DataFrame, pos: str, runs: str) -> DataFrame:
    """One row per account and run: all first runs in account order, then all second ones. Adds run_number and slot (from 1)."""
    e = accounts.withColumn("run_number", F.explode(F.sequence(F.lit(1), F.col(runs)))).filter(F.col(runs) > 0)
    # slots of earlier rounds are the accounts that have such a round: counted per round, few rows
    rounds = e.groupBy("run_number").agg(F.count("*").alias("_n"))
    before = rounds.select("run_number", F.coalesce(F.sum("_n").over(Window.orderBy("run_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    # within a round, accounts are numbered by ranges of their position (a number), so that no task holds a round
    parts = e.withColumn("_part", F.floor(F.col(pos) / RANGE))
    sizes = parts.groupBy("run_number", "_part").agg(F.count("*").alias("_m"))
    sizes = sizes.select("run_number", "_part", F.coalesce(F.sum("_m").over(Window.partitionBy("run_number").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    inside = F.row_number().over(Window.partitionBy("run_number", "_part").orderBy(pos))
    return parts.join(sizes, ["run_number", "_part"]).join(before, "run_number").withColumn("slot", F.col("_b") + F.col("_a") + inside).drop("_b", "_a", "_part")


def isolate_accounts(rows: DataFrame, account: list[str], pos: str, stop: Column, resumed: Column, reason: str) -> DataFrame:
    """Adds status (executed or paused), paused_since and paused_reason: rows of an account after one that stops it are paused, until one that resumes it.

    The row that stops is still executed; a row that resumes is executed itself.
    What one account does changes no row of another: the window is over the account alone, an
    account's slots are bounded by its schedule.
    """
    w = Window.partitionBy(*account).orderBy(pos)
    df = rows.withColumn("_epoch", F.sum(F.when(resumed, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*account, "_epoch").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(stop, F.struct(F.col(pos).alias("at"), F.col(reason).alias("why")))).over(inside)
    df = df.withColumn("_p", F.when(~F.coalesce(resumed, F.lit(False)), first))
    return df.withColumns({"status": F.when(F.col("_p").isNull(), "executed").otherwise("paused"), "paused_since": F.col("_p.at"), "paused_reason": F.col("_p.why")}).drop("_epoch", "_p")


def slot_state(scheduled: Column, now: Column, grace_seconds: int, paused: Column, quota_left: Column) -> Column:
    late = F.unix_timestamp(now) - F.unix_timestamp(scheduled)
    return F.when(late < 0, "future").when(late > grace_seconds, "expired").when(paused, "skipped_paused").when(quota_left <= 0, "skipped_quota").otherwise("due")


def last_message(messages: DataFrame, chat: list[str], turn: str, columns: list[str]) -> DataFrame:
    """The newest message of each chat."""
    return messages.groupBy(*chat).agg(*[F.max_by(c, turn).alias(f"last_{c}") for c in columns], F.max(turn).alias("last_turn"), F.count("*").alias("messages"))


def transcript(messages: DataFrame, chat: list[str], turn: str, line: Column, text: str, last: int) -> DataFrame:
    """The last lines of each chat in order, one a line; messages without text are skipped."""
    m = messages.filter(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("_line", line)
    w = Window.partitionBy(*chat).orderBy(F.desc(turn))
    m = m.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(turn, "_line"))), lambda x: x["_line"])
    return m.groupBy(*chat).agg(F.array_join(lines, "\n").alias("transcript"), F.count("*").alias("lines"))


def first_visits(rows: DataFrame, entity: str, order: str, seen: DataFrame) -> DataFrame:
    """The first row of each entity that was not seen in earlier runs."""
    from jobmill.operators.routing import first_by_position

    return first_by_position(rows, [entity], order).join(seen.select(entity).distinct(), entity, "left_anti")
