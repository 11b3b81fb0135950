"""Cases: open or reuse from results, apply operator commands, verify adjustments, list and audit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlespark import vocab
from settlespark.functions.keyed import first_per_key
from settlespark.functions.ordered import row_numbers

CASE_KEY = ["payment_key", "provider", "provider_transaction_id", "reason"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("payment_key", F.coalesce("payment_id", F.lit("~")))


def detections(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Each result that needs a case beside the earliest case on the same payment, transaction and
    reason, whatever that case's status.  ``reused`` is false where a new case must be opened."""
    todo = _keyed(
        results.join(vocab.outcome_map(results.sparkSession).filter("requires_case"), "outcome")
        .select("batch_id", F.col("id").alias("result_id"), "subject_key", F.col("internal_payment_id").alias("payment_id"),
                "provider", "provider_transaction_id", F.col("outcome").alias("reason"), "severity"))
    known = first_per_key(
        _keyed(cases).select(*CASE_KEY, F.col("id").alias("known_id"), F.col("status").alias("known_status"),
                             F.col("occurrence_count").alias("known_count"), F.col("detected_at").alias("known_at")),
        CASE_KEY, ["known_at", "known_id"])
    return todo.join(known, CASE_KEY, "left").withColumn("reused", F.col("known_id").isNotNull()).withColumn(
        "case_id", F.coalesce("known_id", F.concat(F.lit("rcs_"), "result_id"))).drop("payment_key")


def cases_from_detections(found: DataFrame, cases: DataFrame, detected_at: str) -> DataFrame:
    """The case table after the batch: known cases with their count raised where seen again, and new ones."""
    again = found.filter("reused").groupBy(F.col("known_id").alias("id")).agg(F.count(F.lit(1)).alias("seen"))
    kept = cases.join(again, "id", "left").withColumn(
        "occurrence_count", F.col("occurrence_count") + F.coalesce("seen", F.lit(0))).drop("seen")
    new = found.filter("not reused").select(
        F.col("case_id").alias("id"), "batch_id", "result_id", "payment_id", "provider", "provider_transaction_id", "reason", "severity",
        F.lit("OPEN").alias("status"), F.lit(1).cast("bigint").alias("occurrence_count"),
        F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"))
    return kept.unionByName(new)


def detection_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("batch_id").agg(
        F.count_if(~F.col("reused")).alias("cases_opened"), F.count_if("reused").alias("cases_reused"))


def case_numbers(cases: DataFrame) -> DataFrame:
    return row_numbers(cases, [], ["detected_at", "id"], "case_number")


def case_events_from_results(found: DataFrame) -> DataFrame:
    status = F.coalesce("known_status", F.lit("OPEN"))
    return found.select(
        F.concat(F.lit("cev_"), "result_id").alias("id"), "case_id", status.alias("from_status"), status.alias("to_status"),
        F.when(F.col("reused"), F.concat(F.lit("re-detected: "), "reason", F.lit(" (no status change; occurrence only)")))
        .otherwise(F.concat(F.lit("opened: "), "reason")).alias("note"))


# ------------------------------------------------------------------ commands


def _valid(command: str) -> Column:
    """Whether a command passes the checks that do not depend on the case's status."""
    note_ok = F.length(F.trim(F.coalesce("note", F.lit("")))) >= vocab.MINIMUM_NOTE_LENGTH
    is_action = F.coalesce(F.col("action").isin(*vocab.WRITE_OFF_ACTIONS), F.lit(False))
    return {
        "INVESTIGATE": F.trim(F.coalesce("assigned_to", F.lit(""))) != "",
        "RESOLVE": note_ok,
        "WRITE_OFF": note_ok & is_action,
    }[command]


def apply_case_commands(cases: DataFrame, commands: DataFrame) -> DataFrame:
    """Each command with ACCEPTED or the reason it was refused, and the status it met and left.

    A case is closed by its first well-formed RESOLVE or WRITE_OFF and starts being investigated by its first
    well-formed INVESTIGATE before that, so a case's whole fold is two combinable minimums; a case
    with any number of commands never has to sit in one task.
    """
    checked = commands.withColumn("well_formed", F.expr("false"))
    for name in ("INVESTIGATE", "RESOLVE", "WRITE_OFF"):
        checked = checked.withColumn("well_formed", F.when(F.col("command") == name, _valid(name)).otherwise(F.col("well_formed")))
    closing = F.col("well_formed") & F.col("command").isin("RESOLVE", "WRITE_OFF")
    opening = F.col("well_formed") & (F.col("command") == "INVESTIGATE")
    marks = checked.groupBy("case_id").agg(
        F.min(F.when(closing, F.col("seq"))).alias("closed_seq"),
        F.min_by("command", F.when(closing, F.col("seq"))).alias("closed_by"),
        F.min(F.when(opening, F.col("seq"))).alias("investigated_seq"))
    start = cases.select(F.col("id").alias("case_id"), F.col("status").alias("start_status"))
    df = checked.join(marks.join(start, "case_id", "left"), "case_id")
    df = df.withColumn("met", F.expr("""case
        when start_status is null or start_status in ('RESOLVED', 'WRITTEN_OFF') then start_status
        when closed_seq < seq then case closed_by when 'RESOLVE' then 'RESOLVED' else 'WRITTEN_OFF' end
        when start_status = 'OPEN' and investigated_seq < seq then 'INVESTIGATING'
        else start_status end"""))
    df = df.withColumn("verdict", F.expr(f"""case
        when command = 'INVESTIGATE' and not well_formed then 'OWNER_REQUIRED'
        when command in ('RESOLVE', 'WRITE_OFF') and length(trim(coalesce(note, ''))) < {vocab.MINIMUM_NOTE_LENGTH} then 'NOTE_TOO_SHORT'
        when command = 'WRITE_OFF' and not well_formed then 'ACTION_REQUIRED'
        when met is null then 'NO_SUCH_CASE'
        when command = 'INVESTIGATE' and met <> 'OPEN' then 'INVALID_TRANSITION'
        when met not in ('OPEN', 'INVESTIGATING') then 'INVALID_TRANSITION'
        else 'ACCEPTED' end"""))
    return df.select(
        "case_id", "seq", "command", "verdict", F.col("met").alias("status_before"),
        F.expr("case when verdict <> 'ACCEPTED' then met when command = 'INVESTIGATE' then 'INVESTIGATING' "
               "when command = 'RESOLVE' then 'RESOLVED' else 'WRITTEN_OFF' end").alias("status_after"))


def verify_case_adjustments(citations: DataFrame, cases: DataFrame, headers: DataFrame, links: DataFrame) -> DataFrame:
    """``citations`` (case_id, adjustment_id): the posting must exist, be POSTED and touch the case's payment."""
    posted = headers.select(F.col("id").alias("adjustment_id"), F.col("state").alias("posting_state"))
    owner = cases.select(F.col("id").alias("case_id"), "payment_id")
    linked = links.select("payment_id", F.col("ledger_transaction_id").alias("adjustment_id")).distinct().withColumn("linked", F.lit(True))
    df = citations.join(posted, "adjustment_id", "left").join(owner, "case_id").join(linked, ["payment_id", "adjustment_id"], "left")
    return df.select("case_id", "adjustment_id", "payment_id", F.expr("""case
        when posting_state is null then 'DOES_NOT_EXIST' when posting_state <> 'POSTED' then 'NOT_POSTED'
        when payment_id is not null and linked is null then 'DOES_NOT_TOUCH_PAYMENT' else 'OK' end""").alias("verdict"))


def open_cases(numbered: DataFrame) -> DataFrame:
    urgency = F.expr("case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end")
    return (
        numbered.filter("status in ('OPEN', 'INVESTIGATING')").orderBy(urgency, "detected_at", "id")
        .select("id", F.concat(F.lit("RC-"), F.col("case_number").cast("string")).alias("case_ref"), "payment_id", "provider_transaction_id",
                "reason", "severity", "status", "occurrence_count", "detected_at")
    )


def case_history_breaks(events: DataFrame) -> DataFrame:
    """Events (case_id, seq, id, from_status, to_status) that leave a state the case was not in."""
    in_order = Window.partitionBy("case_id").orderBy("seq", "id")
    chained = events.withColumns({"previous_to": F.lag("to_status").over(in_order), "is_first": F.row_number().over(in_order) == 1})
    return chained.filter("not is_first and not (from_status <=> previous_to)").select(
        "id", "case_id", "seq", "from_status", "previous_to", "to_status")
