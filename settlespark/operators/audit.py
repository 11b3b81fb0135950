"""Audit events: derivation from domain tables, pages, trails and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from settlespark import vocab
from settlespark.operators.ledger import page

COLUMNS = ["id", "actor_type", "actor_id", "action", "entity_type", "entity_id", "request_id", "metadata", "occurred_at"]


def _no_request() -> Column:
    return F.lit(None).cast("string")


def _events(df: DataFrame, ref: Column, actor: tuple[str, str], action: Column, entity_type: str, entity_id: str,
            request_id: Column, metadata: Column, at: str) -> DataFrame:
    return df.select(
        F.concat(F.lit("aud_"), ref).alias("id"), F.lit(actor[0]).alias("actor_type"), F.lit(actor[1]).alias("actor_id"), action.alias("action"),
        F.lit(entity_type).alias("entity_type"), F.col(entity_id).alias("entity_id"), request_id.alias("request_id"),
        F.to_json(metadata).alias("metadata"), F.col(at).alias("occurred_at"))


def _states(history: DataFrame) -> list[DataFrame]:
    return [_events(history, F.col("id"), ("SERVICE", "payments"), F.concat(F.lit("PAYMENT_"), "to_state"), "PAYMENT", "payment_id",
                    F.col("trigger_ref"), F.struct(F.coalesce("from_state", F.lit("-")).alias("from"), F.col("to_state").alias("to")), "occurred_at")]


def _ingested(records: DataFrame) -> list[DataFrame]:
    return [_events(records.withColumn("at", F.col("settlement_date").cast("timestamp_ntz")), F.col("id"), ("WEBHOOK", "provider"),
                    F.expr("case when validity = 'VALID' then 'SETTLEMENT_INGESTED' else 'SETTLEMENT_REJECTED_INVALID' end"), "SETTLEMENT_RECORD", "id",
                    _no_request(), F.struct(F.col("gross_amount_minor").alias("grossMinor")), "at")]


def _paid(payouts: DataFrame) -> list[DataFrame]:
    return [_events(payouts, F.col("id"), ("USER", "operations"), F.lit("PAYOUT_EXECUTED"), "PAYOUT_RECORD", "id",
                    _no_request(), F.struct(F.col("total_net_minor").alias("totalNetMinor"), F.col("line_count").alias("lines")), "executed_at")]


def _batches(batches: DataFrame) -> list[DataFrame]:
    started = _events(batches, F.concat(F.lit("start_"), "id"), ("USER", "operations"), F.lit("RECONCILIATION_BATCH_STARTED"), "RECONCILIATION_BATCH", "id",
                      F.col("request_id"), F.struct("provider"), "started_at")
    done = _events(batches.filter("completed_at is not null"), F.concat(F.lit("done_"), "id"), ("WORKER", "reconciliation"),
                   F.lit("RECONCILIATION_BATCH_COMPLETED"), "RECONCILIATION_BATCH", "id", F.col("request_id"), F.struct("provider"), "completed_at")
    return [started, done]


def _judged(results: DataFrame, batches: DataFrame) -> list[DataFrame]:
    return [_events(results.join(batches.select(F.col("id").alias("batch_id"), "request_id", "completed_at"), "batch_id"), F.col("id"),
                    ("SERVICE", "reconciliation"), F.lit("RECONCILIATION_SUBJECT_CLASSIFIED"), "RECONCILIATION_RESULT", "id",
                    F.col("request_id"), F.struct(F.col("batch_id").alias("batchId"), "outcome"), "completed_at")]


def _acted(commands: DataFrame) -> list[DataFrame]:
    verbs = F.expr("case command when 'INVESTIGATE' then 'CASE_INVESTIGATING' when 'RESOLVE' then 'CASE_RESOLVED' else 'CASE_WRITTEN_OFF' end")
    return [_events(commands, F.concat("case_id", F.lit("_"), F.col("seq").cast("string")), ("USER", "operations"), verbs, "RECONCILIATION_CASE", "case_id",
                    _no_request(), F.struct(F.col("status_before").alias("from"), F.col("status_after").alias("to")), "acted_at")]


def derive_audit_events(history: DataFrame | None = None, records: DataFrame | None = None, payouts: DataFrame | None = None,
                        batches: DataFrame | None = None, results: DataFrame | None = None, commands: DataFrame | None = None) -> DataFrame:
    """One audit row per business fact of the tables given; ``results`` need ``batches``.  ``commands`` are accepted case commands with ``acted_at``."""
    parts = [(_states, history), (_ingested, records), (_paid, payouts), (_batches, batches), (lambda r: _judged(r, batches), results), (_acted, commands)]
    return reduce(DataFrame.unionByName, [df for tell, rows in parts if rows is not None for df in tell(rows)])


def audit_events_page(events: DataFrame, actor_type: str | None = None, action: str | None = None, entity_type: str | None = None,
                      entity_id: str | None = None, start: str | None = None, end: str | None = None, limit: int = 100,
                      after: tuple[str, str] | None = None) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    for column, wanted in (("actor_type", actor_type), ("action", action), ("entity_type", entity_type), ("entity_id", entity_id)):
        if wanted is not None:
            events = events.filter(F.col(column) == wanted)
    if start is not None:
        events = events.filter(F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("occurred_at") < F.lit(end).cast("timestamp_ntz"))
    return page(events, "occurred_at", COLUMNS, limit, after)


def audit_entity_trail(events: DataFrame, entity_type: str, entity_id: str | None = None) -> DataFrame:
    """All events of one entity, or of each entity of a type, newest first."""
    trail = events.filter(F.col("entity_type") == entity_type)
    if entity_id is not None:
        trail = trail.filter(F.col("entity_id") == entity_id)
    return trail.orderBy("entity_id", F.col("occurred_at").desc(), F.col("id").desc())


def audit_unknown_entity_types(events: DataFrame) -> DataFrame:
    published = vocab.dimension(events.sparkSession, [(t,) for t in vocab.AUDIT_ENTITY_TYPES], "entity_type")
    written = events.groupBy("entity_type").agg(F.count(F.lit(1)).alias("events"))
    both = written.join(published.withColumn("published", F.lit(True)), "entity_type", "full_outer")
    return both.filter("events is null or published is null").select(
        "entity_type", F.expr("case when published is null then 'WRITTEN_NOT_PUBLISHED' else 'PUBLISHED_NOT_WRITTEN' end").alias("problem"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def audit_completeness(history: DataFrame, events: DataFrame) -> DataFrame:
    """Payments whose trail lacks the action their history calls for."""
    expected = history.select("payment_id", F.concat(F.lit("PAYMENT_"), "to_state").alias("action")).distinct()
    there = events.filter("entity_type = 'PAYMENT'").select(F.col("entity_id").alias("payment_id"), "action")
    return expected.join(there, ["payment_id", "action"], "left_anti")
