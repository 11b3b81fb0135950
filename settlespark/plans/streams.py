"""Registered streaming jobs: each drains the event (or entry) files as a stream and returns its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlespark.plans import events, payments  # noqa: F401  (shared SQL)
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query
from settlespark.sources.scenario import Scenario, WEBHOOK_SECRET as SECRET
from settlespark.streaming import jobs


def deliveries(s: Scenario):
    return jobs.delivery_stream(jobs.streaming_session(s.spark), f"{s.sf_dir}/events*.parquet")


@query("stream_dedupe_events", """SELECT provider, event_id, arg_min(id, (received_at, id)) AS delivery_id, min(received_at) AS received_at, arg_min(body, (received_at, id)) AS body
FROM classified_deliveries WHERE rejection IS NULL GROUP BY 1, 2""")
def _(s):
    return jobs.run_dedupe_events(deliveries(s), SECRET)


@query("stream_classify_deliveries", """SELECT id, provider, event_id, received_at, outcome, CASE outcome WHEN 'ACCEPTED' THEN 202 WHEN 'DUPLICATE' THEN 200 WHEN 'TOO_LARGE' THEN 413 WHEN 'REJECTED_MALFORMED' THEN 400 ELSE 401 END AS http_status,
  outcome IN ('ACCEPTED', 'DUPLICATE') OR (outcome = 'REJECTED_MALFORMED' AND event_id IS NOT NULL) AS signature_valid FROM classified_deliveries""")
def _(s):
    return jobs.run_classify_deliveries(deliveries(s), SECRET)


@query("stream_provider_status", "SELECT * FROM status_upserts")
def _(s):
    return jobs.run_provider_status(deliveries(s), SECRET)


CTE["stream_marks"] = """
SELECT provider, ptx, min(seq) FILTER (tgt = 'AUTHORIZED') AS a, min(seq) FILTER (tgt = 'CAPTURED') AS c, min(seq) FILTER (tgt = 'REFUNDED') AS r, min(seq) FILTER (tgt = 'FAILED') AS f
FROM (SELECT e.provider, e.provider_transaction_id AS ptx, t.tgt, (e.received_at, e.delivery_id) AS seq FROM provider_events e
    JOIN (VALUES ('payment.created','CREATED'), ('payment.authorized','AUTHORIZED'), ('payment.captured','CAPTURED'), ('payment.refunded','REFUNDED'), ('payment.failed','FAILED')) t(ty, tgt) ON t.ty = e.event_type
    WHERE e.provider_transaction_id IS NOT NULL)
GROUP BY 1, 2"""

# The nine rules on the records of the events, and their lines.
CTE["stream_lines"] = """
SELECT p.provider, p.provider_settlement_id AS sid, l.line_no, l.provider_transaction_id AS ptx, l.line_gross_minor AS lg, l.line_net_minor AS ln FROM pulled p
JOIN pulled_lines l ON l.provider_settlement_id = p.provider_settlement_id AND l.provider_transaction_id IS NOT NULL WHERE p.provider_settlement_id LIKE 'setl\\_%' ESCAPE '\\'"""
CTE["stream_valid"] = """
SELECT DISTINCT p.provider, p.provider_settlement_id AS sid FROM pulled p
JOIN (SELECT sid, sum(lg) AS g, sum(ln) AS n, bool_or(lg < 0 OR ln < 0 OR ln > lg) AS bad, count(*) - count(DISTINCT ptx) AS again FROM stream_lines GROUP BY 1) t ON t.sid = p.provider_settlement_id
WHERE p.gross_amount_minor >= 0 AND p.fee_amount_minor >= 0 AND p.net_amount_minor >= 0 AND NOT t.bad AND t.again = 0 AND upper(trim(p.currency)) IN ('EGP','USD','EUR','GBP')
  AND p.gross_amount_minor = t.g AND p.net_amount_minor = t.n AND p.fee_amount_minor = t.g - t.n
  AND NOT EXISTS (SELECT 1 FROM stream_lines l JOIN event_payments y ON y.provider = l.provider AND y.provider_transaction_id = l.ptx WHERE l.sid = p.provider_settlement_id AND y.currency <> p.currency)"""
CTE["stream_settled"] = """
SELECT DISTINCT l.provider, l.ptx FROM stream_valid v JOIN stream_lines l ON l.sid = v.sid AND l.provider = v.provider
WHERE NOT EXISTS (SELECT 1 FROM stream_lines o JOIN event_payments y ON y.provider = o.provider AND y.provider_transaction_id = o.ptx
    LEFT JOIN stream_marks m ON m.provider = o.provider AND m.ptx = o.ptx WHERE o.sid = v.sid AND (m.c IS NULL OR m.f < m.c))"""


@query("stream_payment_state", """SELECT m.provider, m.ptx AS provider_transaction_id, CASE WHEN f IS NOT NULL AND (c IS NULL OR f < c) THEN 'FAILED' WHEN c IS NOT NULL AND r IS NOT NULL THEN 'REFUNDED'
  WHEN s.ptx IS NOT NULL THEN 'SETTLED' WHEN c IS NOT NULL THEN 'CAPTURED' WHEN a IS NOT NULL THEN 'AUTHORIZED' ELSE 'CREATED' END AS state
FROM stream_marks m JOIN event_payments y ON y.provider = m.provider AND y.provider_transaction_id = m.ptx LEFT JOIN stream_settled s ON s.provider = m.provider AND s.ptx = m.ptx""")
def _(s):
    live = deliveries(s)
    return jobs.run_payment_state(live, SECRET, Scenario(live.sparkSession, s.sf_dir).event_payments)[0]


@query("stream_balances", "SELECT account_id, currency, balance_minor, entry_count FROM recomputed")
def _(s):
    spark = jobs.streaming_session(s.spark)
    return jobs.run_balances(jobs.read_stream(spark, s.path_of("ledger_entries")), Scenario(spark, s.sf_dir).accounts)


@query("stream_settlements", """SELECT p.provider, p.provider_settlement_id, CASE WHEN v.sid IS NULL THEN 'INVALID' ELSE 'VALID' END AS validity, count(l.line_no) AS line_count, CAST(sum(l.lg) AS BIGINT) AS lines_gross
FROM (SELECT DISTINCT provider, provider_settlement_id FROM pulled WHERE provider_settlement_id LIKE 'setl\\_%' ESCAPE '\\') p LEFT JOIN stream_valid v ON v.sid = p.provider_settlement_id AND v.provider = p.provider
LEFT JOIN stream_lines l ON l.sid = p.provider_settlement_id AND l.provider = p.provider GROUP BY ALL""")
def _(s):
    live = deliveries(s)
    known = Scenario(live.sparkSession, s.sf_dir).event_payments
    return jobs.run_settlements(live, SECRET, known).select(
        "provider", "provider_settlement_id", "validity", F.size("lines").cast("bigint").alias("line_count"),
        F.expr("aggregate(lines, 0L, (t, x) -> t + x.grossAmountMinor)").alias("lines_gross"))


@query("stream_dead_letters", """SELECT id, provider, event_id, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.type') END AS event_type, CASE WHEN NOT json_valid(body) THEN 'MALFORMED'
    WHEN json_extract_string(body, '$.providerTransactionId') IS NULL THEN 'NO_TRANSACTION' ELSE 'UNKNOWN_TYPE' END AS reason
FROM checked_deliveries WHERE event_id IS NOT NULL AND (rejection IS NULL OR rejection = 'REJECTED_MALFORMED') AND (NOT json_valid(body)
  OR (json_extract_string(body, '$.type') <> 'settlement.paid' AND (json_extract_string(body, '$.providerTransactionId') IS NULL OR json_extract_string(body, '$.type') = 'payment.disputed')))""")
def _(s):
    return jobs.run_append(jobs.stream_dead_letters(deliveries(s), SECRET), "dead-letters")
