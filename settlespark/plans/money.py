"""Registered money, fee and posting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlespark.operators import fees, postings
from settlespark.plans import attacks, cases
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query

# Amounts bent by rule so that each check has something to find.
CTE["bent_amounts"] = """
SELECT id, currency, CASE WHEN k % 131 = 1 THEN NULL WHEN k % 137 = 2 THEN -amount_minor WHEN k % 139 = 3 THEN amount_minor * 1000000
  WHEN k % 149 = 4 THEN 0 ELSE amount_minor END AS amount_minor FROM payments"""
_BENT = ("case when k % 131 = 1 then null when k % 137 = 2 then -amount_minor when k % 139 = 3 then amount_minor * 1000000 "
         "when k % 149 = 4 then 0 else amount_minor end")


def bent(s):
    return s.payments.select("id", "currency", F.expr(_BENT).alias("amount_minor"))


@query("fee_split", """SELECT id, amount_minor, bps, (amount_minor * bps + 5000) // 10000 AS fee_minor, amount_minor - (amount_minor * bps + 5000) // 10000 AS net_minor
FROM (SELECT id, amount_minor, k * 7 % 10001 AS bps FROM payments)""")
def _(s):
    return fees.fee_split(s.payments.select("id", "amount_minor", F.expr("k * 7 % 10001").alias("bps")))


@query("select_fee_policy", """SELECT id, currency, fee_policy_id, fee_policy_code, bps FROM (
  SELECT p.id, p.currency, f.id AS fee_policy_id, f.code AS fee_policy_code, f.bps, row_number() OVER (PARTITION BY p.id ORDER BY (f.currency = p.currency) DESC) AS rn
  FROM payments p JOIN fee_policies f ON f.active AND (f.currency = p.currency OR f.code = 'DEFAULT')) WHERE rn = 1""")
def _(s):
    return fees.select_fee_policy(s.payments.select("id", "currency"), s.fee_policies)


@query("money_violations", """SELECT id, currency, amount_minor, CASE WHEN amount_minor IS NULL THEN 'MISSING' WHEN amount_minor < 0 THEN 'NEGATIVE'
  WHEN amount_minor > 1000000000000 THEN 'ABOVE_LIMIT' ELSE 'ZERO_GROSS' END AS problem
FROM bent_amounts WHERE amount_minor IS NULL OR amount_minor <= 0 OR amount_minor > 1000000000000""")
def _(s):
    return fees.money_violations(bent(s))


@query("money_display", """SELECT id, currency || ' ' || CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || (abs(amount_minor) // 100) || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0') AS display
FROM bent_amounts""")
def _(s):
    return fees.money_display(bent(s)).select("id", "display")


@query("split_violations", """SELECT 'PAYMENT' AS source, id, g AS gross_minor, platform_fee_minor AS fee_minor, net_amount_minor AS net_minor
FROM (SELECT *, amount_minor + CASE WHEN k % 151 = 9 THEN 5 ELSE 0 END AS g FROM payments) WHERE g <> platform_fee_minor + net_amount_minor
UNION ALL SELECT 'PROVIDER_TRANSACTION', id, gross_amount_minor, f, net_amount_minor
FROM (SELECT *, fee_amount_minor + CASE WHEN merchant_reference = 'MERCH-OTHER' THEN 1 ELSE 0 END AS f FROM provider_transactions) WHERE gross_amount_minor <> net_amount_minor + f
UNION ALL SELECT 'SETTLEMENT_RECORD', id, gross_amount_minor, fee_amount_minor, n
FROM (SELECT *, net_amount_minor - CASE WHEN id LIKE 'srec2_%' THEN 2 ELSE 0 END AS n FROM settlement_records) WHERE validity = 'VALID' AND gross_amount_minor <> n + fee_amount_minor""")
def _(s):
    return fees.split_violations(
        s.payments.withColumn("amount_minor", F.expr("amount_minor + case when k % 151 = 9 then 5 else 0 end")),
        s.provider_transactions.withColumn("fee_amount_minor", F.expr("fee_amount_minor + case when merchant_reference = 'MERCH-OTHER' then 1 else 0 end")),
        s.settlement_records.withColumn("net_amount_minor", F.expr("net_amount_minor - case when id like 'srec2_%' then 2 else 0 end")))


# ------------------------------------------------------------------ postings

_FLAT = """SELECT e.id, e.transaction_id, e.account_code, e.direction, e.amount_minor, e.currency, e.line_no, e.posted_at, t.source_type, t.source_id, t.description
FROM ledger_entries e JOIN ledger_transactions t ON t.id = e.transaction_id WHERE t.type = '{}'"""


def flat(made):
    header = made.select(F.col("id").alias("transaction_id"), "source_type", "source_id", "description")
    lines = postings.entries(made).select("id", "transaction_id", "account_code", "direction", "amount_minor", "currency", "line_no", "posted_at")
    return lines.join(header, "transaction_id")


@query("post_captures", _FLAT.format("PAYMENT_CAPTURE"))
def _(s):
    return flat(s.capture_postings)


@query("post_settlements", _FLAT.format("SETTLEMENT_RECEIVED"))
def _(s):
    return flat(s.settlement_postings)


@query("post_payouts", _FLAT.format("MERCHANT_PAYOUT"))
def _(s):
    return flat(s.payout_postings)


@query("post_refunds_after_settlement", _FLAT.format("PAYMENT_REFUND_SETTLED"))
def _(s):
    return flat(s.refund_postings)


@query("post_reversals", """SELECT e.id, e.transaction_id, e.account_code, e.direction, e.amount_minor, e.line_no, t.reversal_of_transaction_id, t.reversal_reason
FROM ledger_entries e JOIN ledger_transactions t ON t.id = e.transaction_id WHERE t.type = 'REVERSAL'""")
def _(s):
    made = s.reversal_postings
    lines = postings.entries(made).select("id", "transaction_id", "account_code", "direction", "amount_minor", "line_no")
    return lines.join(made.select(F.col("id").alias("transaction_id"), "reversal_of_transaction_id", "reversal_reason"), "transaction_id")


@query("post_psp_adjustments", f"""SELECT 'le_ltx_adj_rcs_' || id || '_' || n AS id, 'ltx_adj_rcs_' || id AS transaction_id,
  CASE n WHEN 1 THEN 'PSP_CLEARING' ELSE 'PLATFORM_CASH' END AS account_code, CASE WHEN (delta_minor > 0) = (n = 1) THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
  abs(delta_minor) AS amount_minor, expected_currency AS currency, CAST(n AS BIGINT) AS line_no, TIMESTAMP '{cases.AT_B}' AS posted_at,
  'RECONCILIATION_CASE' AS source_type, 'rcs_' || id AS source_id, 'PSP adjustment for reconciliation case rcs_' || id AS description
FROM results_b JOIN (VALUES (1), (2)) t(n) ON true WHERE delta_minor <> 0""")
def _(s):
    agreed = cases.results_of(s, "b").filter("delta_minor <> 0").select(
        F.concat(F.lit("rcs_"), "id").alias("case_id"), F.expr("case when delta_minor > 0 then 'CREDIT' else 'DEBIT' end").alias("direction"),
        F.abs("delta_minor").alias("amount_minor"), F.col("expected_currency").alias("currency"),
        F.lit(cases.AT_B).cast("timestamp_ntz").alias("posted_at"))
    return flat(postings.post_psp_adjustments(agreed))


@query("link_payment_postings", "SELECT * FROM ledger_links")
def _(s):
    return postings.link_payment_postings(s.capture_postings, s.refund_postings, s.reversal_postings)


@query("drop_double_postings", """SELECT id, type, source_type, source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_type, source_id, type ORDER BY posted_at, id) AS rn FROM attacked_headers) WHERE type = 'REVERSAL' OR rn = 1""")
def _(s):
    return postings.drop_double_postings(attacks.headers(s)).select("id", "type", "source_type", "source_id")


@query("reject_unpostable_entries", """SELECT e.id AS entry_id, e.transaction_id, e.account_id, e.account_code,
  CASE WHEN a.id IS NULL THEN 'UNKNOWN_ACCOUNT' ELSE 'ACCOUNT_NOT_ACTIVE' END AS reject_reason
FROM attacked_entries e LEFT JOIN attacked_accounts a ON a.id = e.account_id WHERE a.id IS NULL OR a.state <> 'ACTIVE'""")
def _(s):
    return postings.reject_unpostable_entries(attacks.entries(s), attacks.accounts(s))


@query("validate_posting_commands", """SELECT * FROM (
SELECT h.id AS transaction_id, h.type, coalesce(n, 0) AS entry_count, coalesce(debits, 0) AS debits, coalesce(credits, 0) AS credits, CASE
    WHEN zero > 0 THEN 'ZERO_ENTRY' WHEN coalesce(n, 0) < 2 THEN 'TOO_FEW_ENTRIES'
    WHEN source_type NOT IN ('PAYMENT','SETTLEMENT_RECORD','PAYOUT','RECONCILIATION_CASE','SYSTEM') THEN 'UNSUPPORTED_SOURCE'
    WHEN foreign_ccy > 0 THEN 'L2_CURRENCY' WHEN nd = 0 OR nc = 0 THEN 'L3_ONE_SIDED' WHEN debits <> credits THEN 'L1_UNBALANCED'
    WHEN type = 'REVERSAL' AND coalesce(trim(reversal_of_transaction_id), '') = '' THEN 'REVERSAL_WITHOUT_ORIGINAL'
    WHEN type = 'REVERSAL' AND coalesce(trim(reversal_reason), '') = '' THEN 'REVERSAL_WITHOUT_REASON'
    WHEN type <> 'REVERSAL' AND reversal_of_transaction_id IS NOT NULL THEN 'REFERENCE_ON_NON_REVERSAL' END AS failed_rule
FROM attacked_headers h LEFT JOIN (
  SELECT e.transaction_id, count(*) AS n, count(*) FILTER (amount_minor = 0) AS zero, count(*) FILTER (e.currency <> x.currency) AS foreign_ccy,
    CAST(coalesce(sum(amount_minor) FILTER (direction = 'DEBIT'), 0) AS BIGINT) AS debits, CAST(coalesce(sum(amount_minor) FILTER (direction = 'CREDIT'), 0) AS BIGINT) AS credits,
    count(*) FILTER (direction = 'DEBIT') AS nd, count(*) FILTER (direction = 'CREDIT') AS nc
  FROM attacked_entries e JOIN attacked_headers x ON x.id = e.transaction_id GROUP BY e.transaction_id) s ON s.transaction_id = h.id)
WHERE failed_rule IS NOT NULL""")
def _(s):
    return postings.validate_posting_commands(attacks.headers(s), attacks.entries(s))
