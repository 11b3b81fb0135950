"""Ledger, payout and record tables with violations planted by rule, so no check can pass vacuously.

The rules look at the order key inside the payment id; every kind of violation grows with the input and
the rest of the rows are the clean controls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark import vocab
from settlespark.operators import postings
from settlespark.plans.derive_sql import CTE
from settlespark.sources.scenario import Scenario

LEGACY = ("acct_legacy", "LEGACY_SUSPENSE", "Closed suspense", "ASSET", "DEBIT", "CLOSED")

CTE["attacked_accounts"] = """
SELECT * FROM accounts UNION ALL SELECT 'acct_legacy', 'LEGACY_SUSPENSE', 'Closed suspense', 'ASSET', 'DEBIT', 'CLOSED'"""

CTE["keyed_headers"] = """
SELECT *, CASE WHEN source_type = 'PAYMENT' THEN CAST(substring(source_id, 5) AS BIGINT) ELSE -1 END AS kk FROM ledger_transactions"""

CTE["attacked_headers"] = """
SELECT id, CASE WHEN type = 'PAYMENT_CAPTURE' AND kk % 281 = 40 THEN 'MYSTERY' ELSE type END AS type, state, currency,
  CASE WHEN type = 'PAYMENT_CAPTURE' AND kk % 277 = 35 THEN 'GIFT' ELSE source_type END AS source_type, source_id, description,
  CASE WHEN type = 'REVERSAL' AND kk % 23 = 6 THEN id WHEN type = 'PAYMENT_CAPTURE' AND kk % 269 = 31 THEN 'ltx_cap_pay_3' ELSE reversal_of_transaction_id END AS reversal_of_transaction_id,
  CASE WHEN type = 'REVERSAL' AND kk % 19 = 5 THEN NULL ELSE reversal_reason END AS reversal_reason, posted_at
FROM keyed_headers
UNION ALL SELECT id || '_dup', type, state, currency, source_type, source_id, description, reversal_of_transaction_id, reversal_reason, posted_at
FROM keyed_headers WHERE type = 'PAYMENT_CAPTURE' AND kk % 239 = 13
UNION ALL SELECT id || '_again', type, state, currency, source_type, source_id, description, reversal_of_transaction_id, reversal_reason, posted_at
FROM keyed_headers WHERE type = 'REVERSAL' AND kk % 13 = 3
UNION ALL SELECT 'ltx_neg_' || kk, 'MERCHANT_PAYOUT', state, currency, 'PAYOUT', 'neg_' || kk, 'early payout', NULL, NULL, posted_at - INTERVAL 3000 DAY
FROM keyed_headers WHERE type = 'PAYMENT_CAPTURE' AND kk % 271 = 33"""

CTE["keyed_entries"] = """
SELECT e.*, h.type, h.kk FROM ledger_entries e JOIN keyed_headers h ON h.id = e.transaction_id"""

CTE["attacked_entries"] = """
SELECT id, transaction_id, CASE WHEN c AND line_no = 2 AND kk % 257 = 19 THEN 'acct_unknown' WHEN c AND line_no = 2 AND kk % 263 = 21 THEN 'acct_legacy' ELSE account_id END AS account_id,
  CASE WHEN c AND line_no = 2 AND kk % 283 = 41 THEN 'SIDEWAYS' ELSE direction END AS direction,
  CASE WHEN c AND line_no = 3 AND kk % 251 = 17 THEN 0 WHEN c AND line_no = 3 AND kk % 211 = 3 THEN amount_minor + 1
       WHEN type = 'REVERSAL' AND kk % 17 = 4 AND line_no IN (1, 2) THEN amount_minor + 7 ELSE amount_minor END AS amount_minor,
  CASE WHEN c AND line_no = 2 AND kk % 223 = 5 THEN 'JPY' ELSE currency END AS currency,
  CASE WHEN c AND line_no = 2 AND kk % 233 = 11 THEN 'PLATFORM_CASH' WHEN c AND line_no = 2 AND kk % 257 = 19 THEN 'UNKNOWN' WHEN c AND line_no = 2 AND kk % 263 = 21 THEN 'LEGACY_SUSPENSE' ELSE account_code END AS account_code,
  CASE WHEN c AND line_no = 3 AND kk % 241 = 15 THEN CAST(2 AS BIGINT) ELSE line_no END AS line_no, posted_at
FROM (SELECT *, type = 'PAYMENT_CAPTURE' AS c FROM keyed_entries) WHERE NOT (c AND (kk % 229 = 9 OR (kk % 227 = 7 AND line_no > 1)))
UNION ALL SELECT id || '_dup', transaction_id || '_dup', account_id, direction, amount_minor, currency, account_code, line_no, posted_at FROM keyed_entries WHERE type = 'PAYMENT_CAPTURE' AND kk % 239 = 13
UNION ALL SELECT id || '_again', transaction_id || '_again', account_id, direction, amount_minor, currency, account_code, line_no, posted_at FROM keyed_entries WHERE type = 'REVERSAL' AND kk % 13 = 3
UNION ALL SELECT 'le_neg_' || kk || '_' || line_no, 'ltx_neg_' || kk, CASE line_no WHEN 1 THEN 'acct_merchant_payable' ELSE 'acct_platform_cash' END, CASE line_no WHEN 1 THEN 'DEBIT' ELSE 'CREDIT' END,
  gross, currency, CASE line_no WHEN 1 THEN 'MERCHANT_PAYABLE' ELSE 'PLATFORM_CASH' END, line_no, posted_at - INTERVAL 3000 DAY
FROM (SELECT *, max(amount_minor) OVER (PARTITION BY transaction_id) AS gross FROM keyed_entries WHERE type = 'PAYMENT_CAPTURE' AND kk % 271 = 33) WHERE line_no < 3"""


def accounts(s: Scenario) -> DataFrame:
    return vocab.dimension(s.spark, [*vocab.LEDGER_ACCOUNTS, LEGACY], "id, code, name, account_type, normal_side, state")


def _keyed(headers: DataFrame) -> DataFrame:
    return headers.withColumn("kk", F.expr("case when source_type = 'PAYMENT' then cast(substring(source_id, 5) as bigint) else -1 end"))


def headers(s: Scenario) -> DataFrame:
    """Rows of the stored postings, bent while they are read."""
    h = _keyed(s.ledger_transactions)
    cols = s.ledger_transactions.columns
    bent = (
        h.withColumn("reversal_of_transaction_id", F.expr(
            "case when type = 'REVERSAL' and kk % 23 = 6 then id when type = 'PAYMENT_CAPTURE' and kk % 269 = 31 then 'ltx_cap_pay_3' else reversal_of_transaction_id end"))
        .withColumn("reversal_reason", F.expr("case when type = 'REVERSAL' and kk % 19 = 5 then null else reversal_reason end"))
        .withColumn("source_type", F.expr("case when type = 'PAYMENT_CAPTURE' and kk % 277 = 35 then 'GIFT' else source_type end"))
        .withColumn("type", F.expr("case when type = 'PAYMENT_CAPTURE' and kk % 281 = 40 then 'MYSTERY' else type end"))
    )
    twice = h.filter("type = 'PAYMENT_CAPTURE' and kk % 239 = 13").withColumn("id", F.concat("id", F.lit("_dup")))
    again = h.filter("type = 'REVERSAL' and kk % 13 = 3").withColumn("id", F.concat("id", F.lit("_again")))
    early = h.filter("type = 'PAYMENT_CAPTURE' and kk % 271 = 33").select(
        F.expr("concat('ltx_neg_', kk)").alias("id"), F.lit("MERCHANT_PAYOUT").alias("type"), "state", "currency", F.lit("PAYOUT").alias("source_type"),
        F.expr("concat('neg_', kk)").alias("source_id"), F.lit("early payout").alias("description"),
        F.lit(None).cast("string").alias("reversal_of_transaction_id"), F.lit(None).cast("string").alias("reversal_reason"),
        F.expr("posted_at - interval 3000 days").alias("posted_at"))
    return bent.select(*cols).unionByName(twice.select(*cols)).unionByName(again.select(*cols)).unionByName(early)


def entries(s: Scenario) -> DataFrame:
    """Legs of the stored postings, bent while they are read: a posting knows its own type and source, so nothing is joined."""
    e = postings.entries(_keyed(s.all_postings), "type", "kk").withColumn("c", F.expr("type = 'PAYMENT_CAPTURE'"))
    cols = s.ledger_entries.columns
    bent = e.filter("not (c and (kk % 229 = 9 or (kk % 227 = 7 and line_no > 1)))").select(
        "id", "transaction_id",
        F.expr("case when c and line_no = 2 and kk % 257 = 19 then 'acct_unknown' when c and line_no = 2 and kk % 263 = 21 then 'acct_legacy' else account_id end").alias("account_id"),
        F.expr("case when c and line_no = 2 and kk % 283 = 41 then 'SIDEWAYS' else direction end").alias("direction"),
        F.expr("case when c and line_no = 3 and kk % 251 = 17 then 0 when c and line_no = 3 and kk % 211 = 3 then amount_minor + 1 "
               "when type = 'REVERSAL' and kk % 17 = 4 and line_no in (1, 2) then amount_minor + 7 else amount_minor end").alias("amount_minor"),
        F.expr("case when c and line_no = 2 and kk % 223 = 5 then 'JPY' else currency end").alias("currency"),
        F.expr("case when c and line_no = 2 and kk % 233 = 11 then 'PLATFORM_CASH' when c and line_no = 2 and kk % 257 = 19 then 'UNKNOWN' "
               "when c and line_no = 2 and kk % 263 = 21 then 'LEGACY_SUSPENSE' else account_code end").alias("account_code"),
        F.expr("case when c and line_no = 3 and kk % 241 = 15 then 2L else line_no end").alias("line_no"), "posted_at")
    twice = e.filter("c and kk % 239 = 13").withColumns(
        {"id": F.concat("id", F.lit("_dup")), "transaction_id": F.concat("transaction_id", F.lit("_dup"))})
    again = e.filter("type = 'REVERSAL' and kk % 13 = 3").withColumns(
        {"id": F.concat("id", F.lit("_again")), "transaction_id": F.concat("transaction_id", F.lit("_again"))})
    gross = s.payments.filter("k % 271 = 33 and captured_at is not null").select(
        "k", "amount_minor", "currency", F.expr("captured_at - interval 3000 days").alias("posted_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    early = gross.select(
        F.expr("concat('le_neg_', k, '_', n)").alias("id"), F.expr("concat('ltx_neg_', k)").alias("transaction_id"),
        F.expr("case n when 1 then 'acct_merchant_payable' else 'acct_platform_cash' end").alias("account_id"),
        F.expr("case n when 1 then 'DEBIT' else 'CREDIT' end").alias("direction"), "amount_minor", "currency",
        F.expr("case n when 1 then 'MERCHANT_PAYABLE' else 'PLATFORM_CASH' end").alias("account_code"), F.col("n").cast("bigint").alias("line_no"), "posted_at")
    return bent.unionByName(twice.select(*cols)).unionByName(again.select(*cols)).unionByName(early)
