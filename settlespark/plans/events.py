"""Registered ingestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark.operators import ingest as g, settlement
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query
from settlespark.sources.scenario import NOW_EVENTS, Scenario, WEBHOOK_SECRET


def classified(s: Scenario) -> DataFrame:
    return s.keep("classified_deliveries", lambda: g.classify_deliveries(s.deliveries, WEBHOOK_SECRET))


def provider_events(s: Scenario) -> DataFrame:
    """Accepted events with typed columns."""
    return s.keep("provider_events", lambda: g.parse_provider_events(
        classified(s).filter("outcome = 'ACCEPTED'").withColumnRenamed("id", "delivery_id"), accepted=True).drop("reject_reason", "outcome", "http_status"))


@query("parse_provider_events", """SELECT id, CASE WHEN NOT json_valid(body) THEN 'NOT_JSON' END AS reject_reason, j->>'$.type' AS event_type,
  strptime(j->>'$.occurredAt', '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, j->>'$.providerTransactionId' AS provider_transaction_id, j->>'$.merchantReference' AS merchant_reference,
  CAST(j->>'$.gross.amountMinor' AS BIGINT) AS gross_minor, CAST(j->>'$.fee.amountMinor' AS BIGINT) AS fee_minor, CAST(j->>'$.net.amountMinor' AS BIGINT) AS net_minor,
  j->>'$.gross.currency' AS currency, j->>'$.status' AS status, j->>'$.settlement.providerSettlementId' AS settlement_id, CAST(json_array_length(j, '$.settlement.lines') AS BIGINT) AS settlement_lines
FROM (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM deliveries)""")
def _(s):
    return g.parse_provider_events(s.deliveries).select(
        "id", "reject_reason", "event_type", "occurred_at", "provider_transaction_id", "merchant_reference", "gross_minor", "fee_minor", "net_minor", "currency", "status",
        F.col("settlement.providerSettlementId").alias("settlement_id"), F.expr("case when settlement is not null then cast(size(settlement.lines) as bigint) end").alias("settlement_lines"))


@query("verify_event_signature", """SELECT d.id, coalesce(b.e % 43 <> 0 AND d.event_id IS NOT NULL, false) AS signature_valid, d.signature FROM deliveries d JOIN bodied_deliveries b ON d.id = 'del_' || b.e || '_' || b.n""")
def _(s):
    return g.verify_event_signature(s.deliveries, WEBHOOK_SECRET).select("id", "signature_valid", "signature")


@query("filter_event_freshness", """SELECT id, "timestamp" FROM deliveries WHERE abs(CAST(epoch(received_at) AS BIGINT) - CAST("timestamp" AS BIGINT)) <= 300""")
def _(s):
    return g.filter_event_freshness(s.deliveries).select("id", "timestamp")


@query("classify_deliveries", """SELECT id, provider, event_id, received_at, outcome, CASE outcome WHEN 'ACCEPTED' THEN 202 WHEN 'DUPLICATE' THEN 200 WHEN 'TOO_LARGE' THEN 413 WHEN 'REJECTED_MALFORMED' THEN 400 ELSE 401 END AS http_status,
  outcome IN ('ACCEPTED', 'DUPLICATE') OR (outcome = 'REJECTED_MALFORMED' AND event_id IS NOT NULL) AS signature_valid FROM classified_deliveries""")
def _(s):
    return g.classify_deliveries(s.deliveries, WEBHOOK_SECRET).select("id", "provider", "event_id", "received_at", "outcome", "http_status", "signature_valid")


@query("dedupe_provider_events", """SELECT provider, event_id, arg_min(id, (received_at, id)) AS delivery_id, min(received_at) AS received_at, count(*) - 1 AS duplicate_deliveries
FROM classified_deliveries WHERE outcome IN ('ACCEPTED', 'DUPLICATE') GROUP BY 1, 2""")
def _(s):
    return g.dedupe_provider_events(classified(s)).select("provider", "event_id", "delivery_id", "received_at", "duplicate_deliveries")


@query("deliveries_per_event", """SELECT provider, event_id, count(*) AS deliveries, count(*) FILTER (outcome = 'ACCEPTED') AS accepted, count(*) FILTER (outcome = 'DUPLICATE') AS duplicate,
  count(*) FILTER (outcome = 'REJECTED_SIGNATURE') AS rejected_signature, count(*) FILTER (outcome = 'REJECTED_TIMESTAMP') AS rejected_timestamp,
  count(*) FILTER (outcome = 'REJECTED_MALFORMED') AS rejected_malformed, count(*) FILTER (outcome = 'TOO_LARGE') AS too_large
FROM classified_deliveries WHERE event_id IS NOT NULL GROUP BY 1, 2""")
def _(s):
    return g.deliveries_per_event(classified(s))


@query("payload_hash", "SELECT id, sha256(body) AS payload_hash FROM deliveries")
def _(s):
    return g.payload_hash(s.deliveries).select("id", "payload_hash")


# ------------------------------------------------------------------ settlement reports

CTE["pulled"] = """
SELECT provider, w || '_' || substring(j->>'$.providerSettlementId', 6) AS provider_settlement_id, CAST(j->>'$.settlementDate' AS DATE) AS settlement_date, j->>'$.currency' AS currency,
  CAST(j->>'$.grossAmountMinor' AS BIGINT) AS gross_amount_minor, CAST(j->>'$.feeAmountMinor' AS BIGINT) AS fee_amount_minor, CAST(j->>'$.netAmountMinor' AS BIGINT) AS net_amount_minor,
  CAST(substring(j->>'$.providerSettlementId', 6) AS BIGINT) AS num, j, received_at
FROM (SELECT provider, received_at, json_extract(body, '$.settlement') AS j FROM provider_events WHERE event_type = 'settlement.paid') JOIN (VALUES ('setl'), ('setlb')) t(w) ON true"""
CTE["pulled_lines"] = """
SELECT provider, provider_settlement_id, settlement_date, currency, gross_amount_minor, fee_amount_minor, net_amount_minor, CAST(n AS BIGINT) AS line_no,
  json_extract_string(j, '$.lines[' || (n - 1) || '].providerTransactionId') AS provider_transaction_id,
  CAST(json_extract_string(j, '$.lines[' || (n - 1) || '].grossAmountMinor') AS BIGINT) AS line_gross_minor, CAST(json_extract_string(j, '$.lines[' || (n - 1) || '].netAmountMinor') AS BIGINT) AS line_net_minor
FROM pulled JOIN (VALUES (1), (2)) l(n) ON true"""


def reports(s: Scenario) -> DataFrame:
    """Each accepted settlement event as the provider's report would list it: itself and a sibling."""
    body = F.expr("get_json_object(body, '$.settlement')")
    return provider_events(s).filter("event_type = 'settlement.paid'").select(
        "provider", "received_at", F.concat(F.lit("["), body, F.lit(","), F.regexp_replace(body, "setl_", "setlb_"), F.lit("]")).alias("report"))


def pulled(s: Scenario) -> DataFrame:
    return g.settlement_headers(reports(s))


def known_events(s: Scenario) -> DataFrame:
    return pulled(s).filter("cast(regexp_extract(provider_settlement_id, '([0-9]+)$', 1) as bigint) % 3 = 0").select(
        "provider", F.concat(F.lit("sync_"), "provider_settlement_id").alias("event_id"))


@query("flatten_settlement_report", "SELECT *, line_gross_minor - line_net_minor AS line_fee_minor FROM pulled_lines")
def _(s):
    return g.flatten_settlement_report(reports(s))


@query("sync_settlements", """SELECT provider, 'sync_' || provider_settlement_id AS event_id, provider_settlement_id, settlement_date, gross_amount_minor FROM pulled
WHERE num % 3 <> 0 AND settlement_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def _(s):
    return g.sync_settlements(pulled(s), known_events(s), ("2024-01-05", "2024-01-25")).select(
        "provider", "event_id", "provider_settlement_id", "settlement_date", "gross_amount_minor")


@query("sync_summary", "SELECT provider, count(*) AS fetched, count(*) FILTER (num % 3 <> 0) AS ingested, count(*) FILTER (num % 3 = 0) AS already_known FROM pulled GROUP BY 1")
def _(s):
    return g.sync_summary(pulled(s), known_events(s))


@query("normalise_currency", """SELECT id, raw, CASE WHEN upper(trim(raw)) IN ('EGP','USD','EUR','GBP') THEN upper(trim(raw)) END AS normalised, coalesce(upper(trim(raw)) NOT IN ('EGP','USD','EUR','GBP'), true) AS rejected
FROM (SELECT id, CASE WHEN k % 31 = 1 THEN NULL WHEN k % 37 = 2 THEN 'jpy' WHEN k % 5 = 3 THEN ' ' || lower(currency) || ' ' ELSE currency END AS raw FROM payments)""")
def _(s):
    raw = s.payments.select("id", F.expr("case when k % 31 = 1 then null when k % 37 = 2 then 'jpy' when k % 5 = 3 then concat(' ', lower(currency), ' ') else currency end").alias("raw"))
    return g.normalise_currency(raw, "raw")


@query("map_event_target_state", """SELECT event_id, event_type, CASE event_type WHEN 'payment.created' THEN 'CREATED' WHEN 'payment.authorized' THEN 'AUTHORIZED' WHEN 'payment.captured' THEN 'CAPTURED'
    WHEN 'payment.settled' THEN 'SETTLED' WHEN 'payment.refunded' THEN 'REFUNDED' WHEN 'payment.failed' THEN 'FAILED' END AS target_state,
  CASE WHEN event_type = 'settlement.paid' THEN 'SETTLEMENT' WHEN provider_transaction_id IS NULL THEN 'DEAD_NO_TRANSACTION' WHEN event_type = 'payment.disputed' THEN 'DEAD_UNKNOWN_TYPE' ELSE 'PAYMENT' END AS routing
FROM provider_events""")
def _(s):
    return g.map_event_target_state(provider_events(s)).select("event_id", "event_type", "target_state", "routing")


# ------------------------------------------------------------------ commands


@query("classify_commands", """RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY endpoint, idem_key ORDER BY ts, id) AS i FROM command_log),
walk AS (
  SELECT id, endpoint, idem_key, ts, i, id AS owner_id, fingerprint AS ofp, completed AS oc, expires_at AS oe, 'FRESH' AS decision FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.id, n.endpoint, n.idem_key, n.ts, n.i, CASE WHEN w.oe <= n.ts THEN n.id ELSE w.owner_id END, CASE WHEN w.oe <= n.ts THEN n.fingerprint ELSE w.ofp END,
    CASE WHEN w.oe <= n.ts THEN n.completed ELSE w.oc END, CASE WHEN w.oe <= n.ts THEN n.expires_at ELSE w.oe END,
    CASE WHEN w.oe <= n.ts THEN 'EXPIRED_TAKEOVER' WHEN n.fingerprint <> w.ofp THEN 'CONFLICT' WHEN NOT w.oc THEN 'IN_PROGRESS' ELSE 'REPLAY' END
  FROM walk w JOIN numbered n ON n.endpoint = w.endpoint AND n.idem_key = w.idem_key AND n.i = w.i + 1)
SELECT id, endpoint, idem_key, ts, owner_id, decision FROM walk""")
def _(s):
    return g.classify_commands(s.command_log)


@query("command_fingerprint", """SELECT id, sha256('{"bodyHash":"' || sha256(body) || '","method":"' || method || '","pathTemplate":"' || path_template || '"}') AS fingerprint FROM command_log""")
def _(s):
    return g.command_fingerprint(s.command_log.drop("fingerprint")).select("id", "fingerprint")


@query("purge_expired_commands", f"SELECT id, expires_at FROM command_log WHERE expires_at >= TIMESTAMP '{NOW_EVENTS}'")
def _(s):
    return g.purge_expired_commands(s.command_log, NOW_EVENTS).select("id", "expires_at")


# ------------------------------------------------------------------ insert if absent

CTE["event_verdicts"] = """
SELECT p.provider, p.provider_settlement_id, p.num, p.received_at, p.currency, CASE WHEN p.gross_amount_minor <> t.g THEN 'INVALID' ELSE 'VALID' END AS validity
FROM pulled p JOIN (SELECT provider_settlement_id, CAST(sum(line_gross_minor) AS BIGINT) AS g FROM pulled_lines GROUP BY 1) t ON t.provider_settlement_id = p.provider_settlement_id"""


def incoming(s: Scenario) -> DataFrame:
    """Pulled settlements with their verdict; every fourth is delivered again later in another currency."""
    flat = g.flatten_settlement_report(reports(s))
    headers = g.settlement_headers(reports(s)).select(F.col("provider_settlement_id").alias("id"), *g.HEADER)
    lines = flat.filter("provider_transaction_id is not null").select(
        F.col("provider_settlement_id").alias("settlement_record_id"), "provider_transaction_id", "line_gross_minor", "line_net_minor", "line_no")
    verdicts = settlement.validate_settlements(headers, lines, s.event_payments).select("id", "validity")
    rows = headers.join(verdicts, "id").withColumn("num", F.expr("cast(regexp_extract(id, '([0-9]+)$', 1) as bigint)"))
    copies = rows.withColumn("copy", F.explode(F.expr("sequence(1, case when num % 4 = 0 then 2 else 1 end)")))
    return copies.select(
        F.expr("concat(id, '_', copy)").alias("id"), "provider", "provider_settlement_id", "num", F.expr("case when copy = 2 then 'XXX' else currency end").alias("currency"),
        "validity", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(copy)").alias("received_at"))


def incoming_lines(s: Scenario) -> DataFrame:
    """The lines of every incoming copy; the later copy tells other amounts."""
    lines = g.flatten_settlement_report(reports(s)).filter("provider_transaction_id is not null").select(
        "provider_settlement_id", "line_no", "provider_transaction_id", "line_gross_minor", "line_net_minor")
    copies = lines.withColumn("num", F.expr("cast(regexp_extract(provider_settlement_id, '([0-9]+)$', 1) as bigint)")).withColumn(
        "copy", F.explode(F.expr("sequence(1, case when num % 4 = 0 then 2 else 1 end)")))
    return copies.select(
        F.expr("concat(provider_settlement_id, '_', copy)").alias("settlement_record_id"), "line_no", "provider_transaction_id",
        F.expr("line_gross_minor + (copy - 1) * 7").alias("line_gross_minor"), "line_net_minor")


@query("ingest_settlements", """SELECT v.provider, v.provider_settlement_id, v.currency, v.validity, l.line_no, l.provider_transaction_id, l.line_gross_minor, l.line_net_minor FROM event_verdicts v
LEFT JOIN pulled_lines l ON l.provider = v.provider AND l.provider_settlement_id = v.provider_settlement_id AND l.provider_transaction_id IS NOT NULL WHERE v.num % 3 <> 0""")
def _(s):
    new = incoming(s)
    stored = new.filter("num % 3 = 0")
    ingested = g.ingest_settlements(new, stored)
    key = ["provider", "provider_settlement_id"]
    lines = g.ingest_settlement_lines(ingested, incoming_lines(s))
    return ingested.select(*key, "currency", "validity").join(
        lines.select(*key, "line_no", "provider_transaction_id", "line_gross_minor", "line_net_minor"), key, "left")
