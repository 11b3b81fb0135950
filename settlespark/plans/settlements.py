"""Registered settlement and payout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark.operators import payouts as p, settlement as g
from settlespark.plans import ledger
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query
from settlespark.sources.scenario import Scenario


@query("validate_settlements", "SELECT id, validity, rule, validity_reason FROM verdicts")
def _(s):
    return g.validate_settlements(s.statements, s.statement_lines, s.payments)


@query("settlement_total_problems", "SELECT s.id, s.provider_settlement_id, t.problems FROM problem_texts t JOIN statements s ON s.id = t.id WHERE t.problems <> ''")
def _(s):
    return g.settlement_total_problems(s.statements, s.statement_lines)


@query("settlement_line_totals", "SELECT * FROM line_totals")
def _(s):
    return g.settlement_line_totals(s.statement_lines)


@query("latest_settlement_per_txn", "SELECT * FROM latest_settlements")
def _(s):
    return g.latest_settlement_per_txn(s.settlement_records, s.statement_lines)


@query("settlement_coverage", """SELECT l.settlement_record_id, l.line_no, r.provider, l.provider_transaction_id, p.id AS payment_id, p.id IS NULL AS unknown_line
FROM statement_lines l JOIN statements r ON r.id = l.settlement_record_id LEFT JOIN payments p ON p.provider = r.provider AND p.provider_transaction_id = l.provider_transaction_id""")
def _(s):
    return g.settlement_coverage(s.statements, s.statement_lines, s.payments)


@query("refused_settlements", """SELECT provider, currency, count(*) AS refused_records, CAST(sum(gross_amount_minor) AS BIGINT) AS refused_gross, min(validity_reason) AS first_reason
FROM settlement_records WHERE validity = 'INVALID' GROUP BY provider, currency""")
def _(s):
    return g.refused_settlements(s.settlement_records)


@query("settlement_reissues", """SELECT r.provider, l.provider_transaction_id, count(DISTINCT r.id) AS records, min(r.id) AS lowest_record, max(r.id) AS highest_record
FROM statement_lines l JOIN settlement_records r ON r.id = l.settlement_record_id GROUP BY 1, 2 HAVING count(DISTINCT r.id) > 1""")
def _(s):
    return g.settlement_reissues(s.settlement_records, s.statement_lines)


# ------------------------------------------------------------------ payout requests

CTE["payout_requests"] = """
SELECT DISTINCT 'por_' || lpad(CAST(cu AS VARCHAR), 9, '0') AS payout_id, cu, CASE WHEN cu % 11 = 5 THEN 'MERCH-NOBODY' ELSE merchant_reference END AS merchant_reference FROM payments"""
CTE["payout_request_lines"] = """
SELECT 'por_' || lpad(CAST(cu AS VARCHAR), 9, '0') AS payout_id, CASE WHEN cu % 11 = 2 AND k % 4 = 0 THEN 'pay_x' || k ELSE id END AS payment_id
FROM payments JOIN (VALUES (1), (2)) c(copy) ON copy = 1 OR (cu % 11 = 1 AND k % 5 = 0)
WHERE cu % 11 <> 7 AND ((k % 20 >= 8 AND k % 3 = 1) OR (cu % 11 = 3 AND k % 20 IN (5, 6, 7)) OR (cu % 11 = 4 AND paid_out_at IS NOT NULL))"""

CTE["payout_checks"] = """
SELECT r.payout_id, r.merchant_reference, CASE WHEN x.payout_id IS NULL THEN 'EMPTY' WHEN asked > ids THEN 'REPEATED_ID' WHEN unknown_id IS NOT NULL THEN 'NOT_FOUND'
    WHEN bad_id IS NOT NULL THEN bad_problem WHEN foreign_id IS NOT NULL THEN 'MERCHANT_MISMATCH' WHEN lo <> hi THEN 'CURRENCY_MISMATCH' ELSE 'ACCEPTED' END AS verdict,
  unknown_id, bad_id, foreign_id, coalesce(ids, 0) AS payment_count, lo, net
FROM payout_requests r LEFT JOIN (
  SELECT payout_id, CAST(sum(times) AS BIGINT) AS asked, count(*) AS ids, min(payment_id) FILTER (state IS NULL) AS unknown_id, min(payment_id) FILTER (problem IS NOT NULL) AS bad_id,
    arg_min(problem, payment_id) FILTER (problem IS NOT NULL) AS bad_problem, min(payment_id) FILTER (owner <> asked_by) AS foreign_id, min(currency) AS lo, max(currency) AS hi, CAST(sum(net_amount_minor) AS BIGINT) AS net
  FROM (SELECT l.payout_id, l.payment_id, l.times, p.state, p.currency, p.net_amount_minor, p.merchant_reference AS owner, q.merchant_reference AS asked_by,
      CASE WHEN p.state <> 'SETTLED' THEN 'NOT_SETTLED' WHEN p.paid_out_at IS NOT NULL THEN 'ALREADY_PAID' END AS problem
    FROM (SELECT payout_id, payment_id, count(*) AS times FROM payout_request_lines GROUP BY 1, 2) l JOIN payout_requests q ON q.payout_id = l.payout_id LEFT JOIN payments p ON p.id = l.payment_id)
  GROUP BY payout_id) x ON x.payout_id = r.payout_id"""


def requests(s: Scenario) -> DataFrame:
    return s.payments.select(
        F.expr("concat('por_', lpad(cast(cu as string), 9, '0'))").alias("payout_id"),
        F.expr("case when cu % 11 = 5 then 'MERCH-NOBODY' else merchant_reference end").alias("merchant_reference")).distinct()


def request_lines(s: Scenario) -> DataFrame:
    asked = s.payments.filter(
        "cu % 11 <> 7 and ((k % 20 >= 8 and k % 3 = 1) or (cu % 11 = 3 and k % 20 in (5, 6, 7)) or (cu % 11 = 4 and paid_out_at is not null))")
    return asked.withColumn("copy", F.explode(F.expr("sequence(1, case when cu % 11 = 1 and k % 5 = 0 then 2 else 1 end)"))).select(
        F.expr("concat('por_', lpad(cast(cu as string), 9, '0'))").alias("payout_id"),
        F.expr("case when cu % 11 = 2 and k % 4 = 0 then concat('pay_x', k) else id end").alias("payment_id"))


def checks(s: Scenario) -> DataFrame:
    return s.keep("payout_checks", lambda: p.payout_request_checks(requests(s), request_lines(s), s.payments, s.payout_lines))


@query("payout_request_checks", """SELECT payout_id, merchant_reference, verdict, CASE verdict WHEN 'NOT_FOUND' THEN unknown_id WHEN 'NOT_SETTLED' THEN bad_id WHEN 'ALREADY_PAID' THEN bad_id
  WHEN 'MERCHANT_MISMATCH' THEN foreign_id END AS offending_payment, payment_count, CASE WHEN verdict = 'ACCEPTED' THEN lo END AS currency, CASE WHEN verdict = 'ACCEPTED' THEN net END AS total_net_minor FROM payout_checks""")
def _(s):
    return p.payout_request_checks(requests(s), request_lines(s), s.payments, s.payout_lines)


@query("build_payouts", """SELECT c.payout_id, c.merchant_reference, c.lo AS currency, c.net AS total_net_minor, c.payment_count AS line_count, l.payment_id, p.net_amount_minor AS line_net_minor,
  row_number() OVER (PARTITION BY c.payout_id ORDER BY l.payment_id) AS line_no
FROM payout_checks c JOIN payout_request_lines l ON l.payout_id = c.payout_id JOIN payments p ON p.id = l.payment_id WHERE c.verdict = 'ACCEPTED'""")
def _(s):
    return p.build_payouts(checks(s), request_lines(s), s.payments)


# The greedy sequence one request at a time, all currencies in step.
CTE["cash_asks"] = """
SELECT payout_id, lo AS currency, net AS ask, row_number() OVER (PARTITION BY lo ORDER BY payout_id) AS i FROM payout_checks WHERE verdict = 'ACCEPTED'"""


@query("payout_cash_check", """RECURSIVE walk AS (
  SELECT currency, CAST(0 AS BIGINT) AS i, '' AS payout_id, CAST(0 AS BIGINT) AS ask, greatest(balance_minor, 0) AS cash, false AS fits FROM balances WHERE account_id = 'acct_platform_cash'
  UNION ALL SELECT w.currency, a.i, a.payout_id, a.ask, CASE WHEN a.ask <= w.cash THEN w.cash - a.ask ELSE w.cash END, a.ask <= w.cash FROM walk w JOIN cash_asks a ON a.currency = w.currency AND a.i = w.i + 1)
SELECT payout_id, currency, ask AS total_net_minor, CASE WHEN fits THEN 'EXECUTABLE' ELSE 'INSUFFICIENT_CASH' END AS verdict FROM walk WHERE i > 0""")
def _(s):
    return p.payout_cash_check(checks(s), ledger.balances(s))


@query("payout_with_lines", """SELECT r.id, r.merchant_reference, r.currency, r.total_net_minor, r.line_count, r.status, l.line_no, l.payment_id, l.line_net_minor
FROM payout_records r JOIN payout_lines l ON l.payout_record_id = r.id""")
def _(s):
    return p.payout_with_lines(s.payout_records, s.payout_lines)


@query("merchant_payout_history", "SELECT merchant_reference, id, currency, total_net_minor, line_count, executed_at FROM payout_records ORDER BY merchant_reference, executed_at DESC, id")
def _(s):
    return p.merchant_payout_history(s.payout_records)


@query("payable_payments", """SELECT id, merchant_reference, currency, net_amount_minor FROM payments p WHERE state = 'SETTLED' AND NOT EXISTS (SELECT 1 FROM payout_lines l WHERE l.payment_id = p.id)""")
def _(s):
    return p.payable_payments(s.payments, s.payout_lines)
