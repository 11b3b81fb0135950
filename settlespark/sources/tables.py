"""Stored domain tables: explicit schemas, clustered layout, append-only gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from settlespark.session import new_path

SCHEMAS = {
    "payments": "id string, merchant_reference string, amount_minor bigint, currency string, platform_fee_minor bigint, net_amount_minor bigint, "
                "fee_policy_id string, state string, failure_code string, provider string, provider_transaction_id string, settlement_record_id string, "
                "captured_at timestamp_ntz, settled_at timestamp_ntz, paid_out_at timestamp_ntz, expires_at timestamp_ntz, created_at timestamp_ntz",
    "ledger_transactions": "id string, type string, state string, currency string, source_type string, source_id string, description string, "
                           "reversal_of_transaction_id string, reversal_reason string, posted_at timestamp_ntz",
    "ledger_entries": "id string, transaction_id string, account_id string, direction string, amount_minor bigint, currency string, account_code string, "
                      "line_no bigint, posted_at timestamp_ntz",
    "payment_ledger_transactions": "payment_id string, ledger_transaction_id string, role string",
    "payment_state_history": "id string, payment_id string, from_state string, to_state string, trigger_type string, trigger_ref string, occurred_at timestamp_ntz",
    "provider_transactions": "id string, provider string, provider_transaction_id string, payment_id string, merchant_reference string, gross_amount_minor bigint, "
                             "fee_amount_minor bigint, net_amount_minor bigint, currency string, provider_status string, source string, captured_at timestamp_ntz",
    "settlement_records": "id string, provider string, provider_settlement_id string, gross_amount_minor bigint, fee_amount_minor bigint, net_amount_minor bigint, "
                          "currency string, settlement_date date, validity string, validity_reason string",
    "settlement_record_lines": "settlement_record_id string, provider_transaction_id string, line_gross_minor bigint, line_net_minor bigint, line_no bigint",
    "payout_records": "id string, merchant_reference string, currency string, total_net_minor bigint, line_count bigint, status string, "
                      "ledger_transaction_id string, executed_at timestamp_ntz",
    "payout_lines": "payout_record_id string, payment_id string, line_net_minor bigint, line_no bigint",
    "reconciliation_results": "id string, batch_id string, subject_key string, outcome string, internal_payment_id string, provider string, provider_transaction_id string, "
                              "expected_gross_minor bigint, expected_fee_minor bigint, expected_net_minor bigint, expected_currency string, expected_status string, "
                              "actual_gross_minor bigint, actual_fee_minor bigint, actual_net_minor bigint, actual_currency string, actual_status string, "
                              "delta_minor bigint, differences string",
    "currency_units": "code string",
    "fee_policies": "id string, code string, bps int, currency string, active boolean",
    "ledger_accounts": "id string, code string, name string, account_type string, normal_side string, state string",
    "account_balances": "account_id string, currency string, balance_minor bigint, entry_count bigint, last_entry_at timestamp_ntz",
    "idempotency_records": "id string, endpoint string, idem_key string, method string, path_template string, fingerprint string, ts timestamp_ntz, "
                           "completed boolean, expires_at timestamp_ntz",
    "provider_event_deliveries": "id string, provider string, event_id string, outcome string, http_status int, signature_valid boolean, body_bytes int, "
                                 "request_id string, received_at timestamp_ntz",
    "provider_events": "delivery_id string, provider string, event_id string, event_type string, occurred_at timestamp_ntz, provider_transaction_id string, "
                       "merchant_reference string, gross_minor bigint, fee_minor bigint, net_minor bigint, currency string, status string, received_at timestamp_ntz",
    "reconciliation_batches": "id string, provider string, status string, request_id string, started_at timestamp_ntz, completed_at timestamp_ntz",
    "reconciliation_subjects": "batch_id string, subject_key string, provider string, provider_transaction_id string, side string",
    "reconciliation_cases": "id string, batch_id string, result_id string, payment_id string, provider string, provider_transaction_id string, reason string, "
                            "severity string, status string, occurrence_count bigint, detected_at timestamp_ntz",
    "case_events": "id string, case_id string, seq bigint, from_status string, to_status string",
    "audit_events": "id string, actor_type string, actor_id string, action string, entity_type string, entity_id string, request_id string, metadata string, "
                    "occurred_at timestamp_ntz",
}

# Columns with few values become folders, so a filter on them skips files; the order inside a file lets
# Parquet statistics skip row groups for the usual range reads.
LAYOUT = {
    "ledger_entries": (["account_id"], ["posted_at"]),
    "reconciliation_results": (["batch_id"], ["subject_key"]),
    "settlement_records": (["provider"], ["settlement_date"]),
    "reconciliation_cases": (["batch_id"], ["id"]),
    "reconciliation_subjects": (["batch_id"], ["subject_key"]),
    "audit_events": (["entity_type"], ["entity_id"]),
}
#: What both sides are matched by.
MATCHED_BY = ["provider", "provider_transaction_id"]


def write_table(df: DataFrame, name: str, path: str | None = None, mode: str = "append") -> str:
    """Append to a table folder.  Appending with the anti-joins of the operators keeps each answer once."""
    path = path or new_path(df.sparkSession, name)
    folders, order = LAYOUT.get(name, ([], []))
    columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    out = df.select(*columns)
    if order:
        out = out.sortWithinPartitions(*folders, *order)
    writer = out.write.mode(mode)
    (writer.partitionBy(*folders) if folders else writer).parquet(path)
    return path


def replace_partitions(df: DataFrame, name: str, path: str) -> None:
    """Put new rows in the place of the folders that ``df`` has rows for; all other folders stay as they are.  For tables with folders only."""
    folders, order = LAYOUT[name]
    columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    out = df.select(*columns).sortWithinPartitions(*folders, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: list[str] | None = None) -> DataFrame:
    """A catalogue table dealt by the matching key, and sorted by it within a bucket.

    Aggregates and joins on the key of tables with one number of buckets need no exchange, whoever runs them later.  The number follows
    the table: rows of a bucket should fit a task.
    """
    keys = keys or MATCHED_BY
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw event bodies, one JSON document per line, kept as text for verification and parsing."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text, as the snapshot listing is exchanged."""
    df.write.mode("error").option("sep", "\t").option("header", True).csv(path)
