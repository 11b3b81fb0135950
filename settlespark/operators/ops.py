"""Operations: metrics, health, stuck work and the retry decision of failed events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from settlespark import vocab


def metrics_summary(payments: DataFrame, cases: DataFrame, events: DataFrame, batches: DataFrame, results: DataFrame) -> DataFrame:
    """(metric, label, value) rows; the delta is given over all batches and over the latest batch alone."""
    def by(df: DataFrame, column: str, metric: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "label", "value")

    def total(df: DataFrame, condition: str, metric: str) -> DataFrame:
        return df.agg(F.expr(f"count_if({condition})").alias("value")).select(F.lit(metric).alias("metric"), F.lit("-").alias("label"), "value")

    open_delta = results.filter("delta_minor is not null and outcome <> 'MATCHED'").groupBy("batch_id").agg(F.sum("delta_minor").alias("d"))
    deltas = open_delta.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("every"), F.coalesce(F.max_by("d", "batch_id"), F.lit(0)).alias("latest"))
    return reduce(DataFrame.unionByName, [
        by(payments, "state", "payments_by_state"), by(cases, "status", "cases_by_status"),
        total(cases, "status in ('OPEN', 'INVESTIGATING')", "open_cases"),
        total(events, "status = 'FAILED'", "failed_provider_events"), total(events, "status = 'DEAD'", "dead_events"),
        total(batches, "status = 'RUNNING'", "running_batches"),
        deltas.select(F.lit("unreconciled_delta_minor").alias("metric"), F.lit("-").alias("label"), F.col("every").alias("value")),
        deltas.select(F.lit("unreconciled_delta_minor_latest_batch").alias("metric"), F.lit("-").alias("label"), F.col("latest").alias("value")),
    ])


def stuck_batches(batches: DataFrame, now: str) -> DataFrame:
    lease = F.expr(f"timestamp_ntz'{now}' - interval {vocab.BATCH_LEASE_MINUTES} minutes")
    return batches.filter((F.col("status") == "RUNNING") & (F.col("started_at") < lease)).select("id", "provider", "started_at")


def health_report(drift: DataFrame, stuck: DataFrame) -> DataFrame:
    def check(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("check_name"), "findings")

    checks = check(drift, "ledger").unionByName(check(stuck, "stuck_batches"))
    overall = checks.agg(F.sum("findings").alias("findings")).select(F.lit("overall").alias("check_name"), "findings")
    return checks.withColumn("status", F.expr("case when findings = 0 then 'PASS' else 'FAIL' end")).unionByName(
        overall.withColumn("status", F.expr("case when findings = 0 then 'UP' else 'DOWN' end")))


def failed_events(events: DataFrame, limit: int) -> DataFrame:
    return events.filter("status in ('FAILED', 'DEAD')").orderBy("next_attempt_at", "id").limit(limit).select(
        "id", "event_id", "status", "attempts", "deferred_attempts", "next_attempt_at")


def event_retry_state(events: DataFrame) -> DataFrame:
    """``events``: id, error_class (NON_RETRYABLE, BLOCKED, TRANSIENT), attempts, deferred_attempts, after a failed pass.
    The wait is the cap of the random one."""
    return events.select(
        "id", "error_class",
        F.expr(f"""case when error_class = 'NON_RETRYABLE' then 'DEAD'
            when error_class = 'BLOCKED' then case when deferred_attempts + 1 >= {vocab.MAX_DEFERRALS} then 'DEAD' else 'PENDING' end
            when attempts >= {vocab.MAX_ATTEMPTS} then 'FAILED' else 'PENDING' end""").alias("next_status"),
        F.expr(f"case when error_class = 'BLOCKED' and deferred_attempts + 1 < {vocab.MAX_DEFERRALS} then greatest(attempts - 1, 0) else attempts end").cast("bigint").alias("next_attempts"),
        F.expr(f"case when error_class = 'BLOCKED' and deferred_attempts + 1 < {vocab.MAX_DEFERRALS} then deferred_attempts + 1 else deferred_attempts end").cast("bigint").alias("next_deferrals"),
        F.expr(f"case when error_class = 'TRANSIENT' then least({vocab.BACKOFF_CAP_SECONDS}, {vocab.BACKOFF_BASE_SECONDS} * shiftleft(1L, least(cast(attempts as int), 20))) else 0 end").cast("bigint").alias("wait_at_most_seconds"),
    )


def claimable_events(events: DataFrame, now: str, limit: int) -> DataFrame:
    due = events.filter(
        F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt_at") <= F.lit(now).cast("timestamp_ntz"))
        & (F.col("attempts") < vocab.MAX_ATTEMPTS) & (F.col("deferred_attempts") < vocab.MAX_DEFERRALS))
    return due.orderBy("next_attempt_at", "id").limit(limit).select("id", "event_id", "status", "attempts", "deferred_attempts", "next_attempt_at")


def stale_claims(events: DataFrame, now: str) -> DataFrame:
    cutoff = F.expr(f"timestamp_ntz'{now}' - interval {vocab.STALE_CLAIM_SECONDS} seconds")
    return events.filter((F.col("status") == "PROCESSING") & (F.col("locked_at") < cutoff)).select("id", "event_id", "locked_at")
