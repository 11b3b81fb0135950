"""Registered payment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark.operators import ingest, payments as p
from settlespark.plans import cases, events
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query
from settlespark.sources.scenario import NOW_ORDERS, Scenario
from settlespark import vocab


@query("transition_violations", """SELECT id, payment_id, from_state, previous_to, to_state, problem FROM (
SELECT h.*, CASE WHEN rn = 1 THEN CASE WHEN from_state IS NULL AND to_state = 'CREATED' THEN NULL ELSE 'BAD_START' END
    WHEN NOT EXISTS (SELECT 1 FROM transitions x WHERE x.f = h.from_state AND x.t = h.to_state) THEN 'NOT_ALLOWED'
    WHEN from_state IS DISTINCT FROM previous_to THEN 'BROKEN_CHAIN' END AS problem
FROM (SELECT *, lag(to_state) OVER w AS previous_to, row_number() OVER w AS rn FROM state_history WINDOW w AS (PARTITION BY payment_id ORDER BY occurred_at, id)) h) WHERE problem IS NOT NULL""")
def _(s):
    return p.transition_violations(s.state_history)


@query("transition_matrix", """SELECT a.state AS from_state, b.state AS to_state, EXISTS (SELECT 1 FROM transitions x WHERE x.f = a.state AND x.t = b.state) AS allowed,
  (SELECT count(*) FROM state_history h WHERE h.from_state = a.state AND h.to_state = b.state) AS observed FROM ranks a CROSS JOIN ranks b""")
def _(s):
    seen = s.state_history.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("observed"))
    return p.transition_matrix(s.spark).join(seen, ["from_state", "to_state"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("bigint"))


# The effect of each (current, target) pair, written out.
CTE["decisions"] = """
SELECT a.state AS cur, b.state AS tgt, CASE WHEN x.f IS NOT NULL THEN 'APPLY' WHEN a.rank >= b.rank THEN 'NO_EFFECT' ELSE 'APPLY_OUT_OF_ORDER' END AS decision,
  CASE WHEN x.f IS NULL AND a.rank >= b.rank THEN 'NO_EFFECT' WHEN b.state = 'SETTLED' THEN 'DEAD' WHEN x.f IS NOT NULL OR (a.state = 'CREATED' AND b.state = 'CAPTURED') THEN 'PROCESSED' ELSE 'RETRY' END AS effect
FROM ranks a CROSS JOIN ranks b LEFT JOIN transitions x ON x.f = a.state AND x.t = b.state"""

CTE["payment_events"] = """
SELECT e.event_id, p.id AS payment_id, t.target_state, e.received_at, e.delivery_id, row_number() OVER (PARTITION BY p.id ORDER BY e.received_at, e.delivery_id) AS i
FROM provider_events e JOIN (VALUES ('payment.created','CREATED'), ('payment.authorized','AUTHORIZED'), ('payment.captured','CAPTURED'), ('payment.settled','SETTLED'),
  ('payment.refunded','REFUNDED'), ('payment.failed','FAILED')) t(event_type, target_state) ON t.event_type = e.event_type
JOIN event_payments p ON p.provider = e.provider AND p.provider_transaction_id = e.provider_transaction_id"""


def payment_events(s: Scenario) -> DataFrame:
    """Accepted payment events that found their payment."""
    routed = ingest.map_event_target_state(events.provider_events(s)).filter("routing = 'PAYMENT'")
    ours = s.event_payments.select(F.col("id").alias("payment_id"), "provider", "provider_transaction_id")
    return routed.join(ours, ["provider", "provider_transaction_id"]).select("event_id", "payment_id", "target_state", "received_at", "delivery_id")


# The replay one event at a time.  ``waiting`` holds the retried refunds and failures by event id; it is
# looked at again whenever the state has changed.
WALK = """RECURSIVE walk AS (
  SELECT id AS payment_id, CAST(0 AS BIGINT) AS i, state, '' AS met, '' AS event_id, '' AS target_state, CAST(NULL AS VARCHAR) AS first_refund, '' AS decision, '' AS effect, CAST(NULL AS VARCHAR) AS released FROM event_payments
  UNION ALL
  SELECT w.payment_id, e.i,
    CASE WHEN d.effect <> 'PROCESSED' THEN w.state WHEN e.target_state = 'CAPTURED' AND w.first_refund IS NOT NULL THEN 'REFUNDED' ELSE e.target_state END,
    w.state, e.event_id, e.target_state,
    CASE WHEN d.effect = 'RETRY' AND e.target_state = 'REFUNDED' AND w.first_refund IS NULL THEN e.event_id ELSE w.first_refund END,
    d.decision, d.effect, CASE WHEN d.effect = 'PROCESSED' AND e.target_state = 'CAPTURED' THEN w.first_refund END
  FROM walk w JOIN payment_events e ON e.payment_id = w.payment_id AND e.i = w.i + 1 JOIN decisions d ON d.cur = w.state AND d.tgt = e.target_state)"""


@query("event_decision", WALK + """
SELECT event_id, target_state, met AS current_state, decision, effect FROM walk WHERE i > 0""")
def _(s):
    return p.event_decisions(payment_events(s), s.event_payments)


@query("fold_payment_events", WALK + """
SELECT w.event_id, w.payment_id, w.target_state, w.met AS state_met, w.decision, w.effect = 'RETRY' AS retried,
  CASE WHEN w.effect <> 'RETRY' THEN w.effect WHEN r.released = w.event_id THEN 'PROCESSED' WHEN f.state = 'REFUNDED' AND f.refunded_i > w.i THEN 'NO_EFFECT' ELSE 'FAILED' END AS final_effect, f.state AS final_state
FROM walk w JOIN (SELECT payment_id, arg_max(state, i) AS state, min(i) FILTER (state = 'REFUNDED') AS refunded_i FROM walk GROUP BY 1) f ON f.payment_id = w.payment_id
LEFT JOIN (SELECT payment_id, max(released) AS released FROM walk WHERE released IS NOT NULL GROUP BY 1) r ON r.payment_id = w.payment_id
WHERE w.i > 0""")
def _(s):
    return p.fold_payment_events(payment_events(s), s.event_payments)


CTE["status_events"] = """
SELECT provider, provider_transaction_id, coalesce(json_extract_string(body, '$.merchantReference'), 'UNKNOWN') AS merchant_reference,
  CAST(json_extract_string(body, '$.gross.amountMinor') AS BIGINT) AS g, CAST(json_extract_string(body, '$.fee.amountMinor') AS BIGINT) AS f, CAST(json_extract_string(body, '$.net.amountMinor') AS BIGINT) AS n,
  json_extract_string(body, '$.gross.currency') AS currency, coalesce(json_extract_string(body, '$.status'), 'CAPTURED') AS status, occurred_at, received_at, delivery_id
FROM provider_events WHERE event_type LIKE 'payment.%' AND event_type <> 'payment.disputed' AND provider_transaction_id IS NOT NULL"""


CTE["status_upserts"] = """
SELECT e.provider, e.provider_transaction_id, arg_max(e.merchant_reference, (received_at, delivery_id)) AS merchant_reference, arg_max(g, (received_at, delivery_id)) AS gross_minor,
  arg_max(coalesce(f, g - n), (received_at, delivery_id)) AS fee_minor, arg_max(n, (received_at, delivery_id)) AS net_minor, arg_max(e.currency, (received_at, delivery_id)) AS currency,
  arg_max(e.status, r.rank) AS provider_status, arg_min(occurred_at, (received_at, delivery_id)) AS captured_at
FROM status_events e JOIN ranks r ON r.state = e.status WHERE g IS NOT NULL AND n IS NOT NULL GROUP BY 1, 2"""


def status_events(s: Scenario) -> DataFrame:
    return ingest.map_event_target_state(events.provider_events(s)).filter("routing = 'PAYMENT'")


@query("provider_status_upsert", "SELECT * FROM status_upserts")
def _(s):
    return p.provider_status_upsert(status_events(s))


@query("provider_claims_from_settlement", """SELECT c.provider, c.provider_transaction_id, p.id AS payment_id, coalesce(p.merchant_reference, 'UNKNOWN') AS merchant_reference, c.g AS gross_amount_minor, c.g - c.n AS fee_amount_minor, c.n AS net_amount_minor,
  c.currency, 'SETTLED' AS provider_status, 'WEBHOOK' AS source, p.captured_at
FROM (SELECT r.provider, l.provider_transaction_id, r.currency, l.line_gross_minor AS g, l.line_net_minor AS n, row_number() OVER (PARTITION BY r.provider, l.provider_transaction_id ORDER BY r.id, l.line_no) AS rn
  FROM statement_lines l JOIN statements r ON r.id = l.settlement_record_id
  WHERE NOT EXISTS (SELECT 1 FROM provider_transactions x WHERE x.provider = r.provider AND x.provider_transaction_id = l.provider_transaction_id)) c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider, provider_transaction_id ORDER BY id) AS rn FROM payments) p ON p.rn = 1 AND p.provider = c.provider AND p.provider_transaction_id = c.provider_transaction_id
WHERE c.rn = 1""")
def _(s):
    return p.provider_claims_from_settlement(s.statements, s.statement_lines, s.payments, s.provider_transactions)


@query("promote_settled_status", """SELECT x.id, x.provider, x.provider_transaction_id, x.provider_status AS status_before,
  CASE WHEN r.rank < 4 AND EXISTS (SELECT 1 FROM statement_lines l JOIN settlement_records s ON s.id = l.settlement_record_id WHERE s.validity = 'VALID' AND s.provider = x.provider AND l.provider_transaction_id = x.provider_transaction_id)
    THEN 'SETTLED' ELSE x.provider_status END AS status_after FROM provider_transactions x JOIN ranks r ON r.state = x.provider_status""")
def _(s):
    covered = s.statement_lines.join(s.settlement_records.filter("validity = 'VALID'").select(F.col("id").alias("settlement_record_id"), "provider"), "settlement_record_id")
    return p.promote_settled_status(s.provider_transactions, covered)


# Settlement meets payments as they stood before it: some settled ones are put back to an earlier state.
CTE["earlier_payments"] = """
SELECT id, provider, provider_transaction_id, settlement_record_id, CASE WHEN k % 97 = 17 AND state = 'SETTLED' THEN 'AUTHORIZED' WHEN state = 'SETTLED' AND k % 2 = 0 THEN 'CAPTURED' ELSE state END AS state FROM payments"""


@query("settle_outcomes", """SELECT settlement_record_id, payment_id, state, outcome, bool_or(outcome = 'NOT_CAPTURED') OVER (PARTITION BY settlement_record_id) AS record_blocked FROM (
  SELECT r.id AS settlement_record_id, p.id AS payment_id, p.state, CASE WHEN p.state = 'SETTLED' THEN 'ALREADY_SETTLED' WHEN p.state IN ('FAILED','REFUNDED') THEN 'SUPERSEDED' WHEN p.state = 'CAPTURED' THEN 'SETTLED_NOW' ELSE 'NOT_CAPTURED' END AS outcome
  FROM settlement_records r JOIN statement_lines l ON l.settlement_record_id = r.id JOIN earlier_payments p ON p.provider = r.provider AND p.provider_transaction_id = l.provider_transaction_id WHERE r.validity = 'VALID')""")
def _(s):
    earlier = s.payments.withColumn("state", F.expr(
        "case when k % 97 = 17 and state = 'SETTLED' then 'AUTHORIZED' when state = 'SETTLED' and k % 2 = 0 then 'CAPTURED' else state end"))
    return p.settle_outcomes(s.settlement_records, s.statement_lines, earlier)


@query("capture_checks", """SELECT payment_id, CASE WHEN p.id IS NULL THEN 'NO_SUCH_PAYMENT' WHEN state <> 'AUTHORIZED' THEN 'INVALID_STATE'
  WHEN expected_minor IS NOT NULL AND (expected_minor <> amount_minor OR expected_currency <> p.currency) THEN 'AMOUNT_MISMATCH' WHEN requested_at > expires_at THEN 'EXPIRED' ELSE 'OK' END AS verdict
FROM (SELECT CASE WHEN k % 61 = 2 THEN 'pay_none_' || k ELSE id END AS payment_id, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 1 THEN amount_minor + 1 ELSE amount_minor END AS expected_minor,
    CASE WHEN k % 3 = 0 THEN NULL WHEN k % 11 = 1 THEN 'XXX' ELSE currency END AS expected_currency, created_at + to_days(CASE WHEN k % 13 = 2 THEN 8 ELSE 7 END) AS requested_at FROM payments) q LEFT JOIN payments p ON p.id = q.payment_id""")
def _(s):
    asked = s.payments.select(
        F.expr("case when k % 61 = 2 then concat('pay_none_', k) else id end").alias("payment_id"),
        F.expr("case when k % 3 = 0 then null when k % 7 = 1 then amount_minor + 1 else amount_minor end").alias("expected_minor"),
        F.expr("case when k % 3 = 0 then null when k % 11 = 1 then 'XXX' else currency end").alias("expected_currency"),
        F.expr("created_at + make_dt_interval(case when k % 13 = 2 then 8 else 7 end)").alias("requested_at"))
    return p.capture_checks(asked, s.payments)


@query("refund_routes", """SELECT id AS payment_id, state, route, CASE WHEN route = 'REVERSE_CAPTURE' THEN 'ltx_cap_' || id END AS reverses FROM (
  SELECT p.id, state, CASE WHEN state NOT IN ('CAPTURED','SETTLED') THEN 'INVALID_STATE' WHEN EXISTS (SELECT 1 FROM payout_lines l JOIN payout_records r ON r.id = l.payout_record_id AND r.status = 'EXECUTED' WHERE l.payment_id = p.id) THEN 'ALREADY_PAID_OUT'
    WHEN state = 'SETTLED' THEN 'REFUND_POSTING' WHEN NOT EXISTS (SELECT 1 FROM ledger_links k WHERE k.payment_id = p.id AND k.role = 'CAPTURE') THEN 'NO_CAPTURE' ELSE 'REVERSE_CAPTURE' END AS route FROM payments p)""")
def _(s):
    return p.refund_routes(s.payments, s.ledger_links, s.payout_records, s.payout_lines)


@query("payments_page", """SELECT id, merchant_reference, state, amount_minor, currency, created_at, (SELECT count(*) > 50 FROM page_rows) AS has_more FROM page_rows ORDER BY created_at DESC, id DESC LIMIT 50""".replace(
    "page_rows", "(SELECT * FROM payments WHERE state = 'SETTLED' AND (created_at, id) < (TIMESTAMP '2000-01-15 00:00:00', 'pay_5') ORDER BY created_at DESC, id DESC LIMIT 51)"))
def _(s):
    return p.payments_page(s.payments, state="SETTLED", after=("2000-01-15 00:00:00", "pay_5"))


# Events name their own transactions; an order payment hears those of the event payment with its number.
CTE["timeline_payments"] = "SELECT id, provider, 'psp_e' || k AS provider_transaction_id FROM payments"
CTE["batches"] = """
SELECT * FROM (VALUES ('rbat_a', 'SIMULATED_PSP', 'COMPLETED', 'req_batch_a', TIMESTAMP '2002-01-01 00:00:00', TIMESTAMP '2002-01-01 00:10:00'),
  ('rbat_b', 'SIMULATED_PSP', 'COMPLETED', 'req_batch_b', TIMESTAMP '2002-01-02 00:00:00', TIMESTAMP '2002-01-02 00:10:00')) t(id, provider, status, request_id, started_at, completed_at)"""


def batches(s: Scenario) -> DataFrame:
    """The two completed batches as control rows."""
    rows = vocab.dimension(s.spark, [("rbat_a", "SIMULATED_PSP", "COMPLETED", "req_batch_a", "2002-01-01 00:00:00", "2002-01-01 00:10:00"),
                                     ("rbat_b", "SIMULATED_PSP", "COMPLETED", "req_batch_b", "2002-01-02 00:00:00", "2002-01-02 00:10:00")],
                           "id, provider, status, request_id, started_at, completed_at")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at")})


@query("payment_timeline", """SELECT payment_id, occurred_at, 'STATE' AS kind, id AS reference, CASE WHEN from_state IS NULL THEN 'payment created' ELSE 'state ' || from_state || ' -> ' || to_state END AS summary, trigger_ref AS request_id FROM state_history
UNION ALL SELECT l.payment_id, t.posted_at, 'LEDGER', t.id, 'posted ' || t.type || ' (' || t.description || ')', NULL FROM ledger_links l JOIN ledger_transactions t ON t.id = l.ledger_transaction_id
UNION ALL SELECT p.id, e.occurred_at, 'WEBHOOK', e.event_id, 'provider event ' || e.event_type || ' -> PROCESSED', d.request_id
  FROM timeline_payments p JOIN provider_events e ON e.provider = p.provider AND e.provider_transaction_id = p.provider_transaction_id
  JOIN (SELECT provider, event_id, arg_min(request_id, (received_at, id)) AS request_id FROM deliveries WHERE event_id IS NOT NULL GROUP BY 1, 2) d ON d.provider = e.provider AND d.event_id = e.event_id
UNION ALL SELECT r.internal_payment_id, b.completed_at, 'RECONCILIATION', r.id, 'reconciliation ' || r.outcome || coalesce(' (delta ' || r.delta_minor || ')', ' (no delta)'), b.request_id
  FROM (SELECT * FROM results_a UNION ALL SELECT * FROM results_b) r JOIN batches b ON b.id = r.batch_id WHERE r.internal_payment_id IS NOT NULL""")
def _(s):
    ours = s.payments.select("id", "provider", F.expr("concat('psp_e', k)").alias("provider_transaction_id"))
    both = cases.results_of(s, "a").unionByName(cases.results_of(s, "b"))
    heard = events.provider_events(s).drop("status").withColumn("status", F.lit("PROCESSED"))
    return p.payment_timeline(s.state_history, s.ledger_links, s.ledger_transactions, ours, heard, s.deliveries, both, batches(s))


@query("provider_txn_claims", """SELECT provider, provider_transaction_id, count(*) AS claims, min(id) AS first_payment, max(id) AS last_payment FROM payments WHERE provider_transaction_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def _(s):
    return p.provider_txn_claims(s.payments)


@query("history_completeness", """SELECT p.id AS payment_id, p.state, h.last_state, coalesce(h.n, 0) AS rows, coalesce(h.moves, 0) AS transitions FROM payments p
LEFT JOIN (SELECT payment_id, count(*) AS n, count(from_state) AS moves, arg_max(to_state, (occurred_at, id)) AS last_state FROM state_history GROUP BY 1) h ON h.payment_id = p.id
WHERE h.n IS NULL OR h.n <> h.moves + 1 OR h.last_state <> p.state""")
def _(s):
    return p.history_completeness(s.state_history, s.payments)


@query("expired_uncaptured", f"SELECT id, state, expires_at FROM payments WHERE state IN ('CREATED','AUTHORIZED') AND expires_at < TIMESTAMP '{NOW_ORDERS}'")
def _(s):
    return p.expired_uncaptured(s.payments, NOW_ORDERS)
