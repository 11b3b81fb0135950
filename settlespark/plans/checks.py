"""Registered invariant checks over the tables with planted violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark import vocab
from settlespark.operators import checks as k
from settlespark.plans import attacks, audit_ops, cases, events, ledger, matching, payments
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query
from settlespark.sources.scenario import Scenario


@query("ledger_unbalanced", """SELECT *, debits - credits AS difference FROM (
  SELECT transaction_id, CAST(coalesce(sum(amount_minor) FILTER (direction = 'DEBIT'), 0) AS BIGINT) AS debits, CAST(coalesce(sum(amount_minor) FILTER (direction = 'CREDIT'), 0) AS BIGINT) AS credits
  FROM attacked_entries GROUP BY transaction_id) WHERE debits <> credits""")
def _(s):
    return k.ledger_unbalanced(attacks.entries(s))


@query("ledger_currency_breaks", """SELECT h.id AS transaction_id, h.currency AS header_currency, min(e.currency) AS lowest, max(e.currency) AS highest, count(DISTINCT e.currency) > 1 AS mixed
FROM attacked_headers h JOIN attacked_entries e ON e.transaction_id = h.id GROUP BY h.id, h.currency HAVING bool_or(e.currency <> h.currency)""")
def _(s):
    return k.ledger_currency_breaks(attacks.headers(s), attacks.entries(s))


@query("ledger_shape_breaks", """SELECT transaction_id, entry_count, problems FROM (
  SELECT transaction_id, count(*) AS entry_count, concat_ws(',', CASE WHEN count(*) < 2 THEN 'TOO_FEW' END,
    CASE WHEN count(*) FILTER (direction = 'DEBIT') = 0 OR count(*) FILTER (direction = 'CREDIT') = 0 THEN 'ONE_SIDED' END,
    CASE WHEN min(amount_minor) <= 0 THEN 'AMOUNT_NOT_POSITIVE' END, CASE WHEN min(line_no) < 1 OR count(DISTINCT line_no) < count(*) THEN 'LINE_NUMBERS' END) AS problems
  FROM attacked_entries GROUP BY transaction_id) WHERE problems <> ''""")
def _(s):
    return k.ledger_shape_breaks(attacks.entries(s))


@query("ledger_empty_headers", """SELECT h.id AS transaction_id, h.type, count(e.id) AS entry_count FROM attacked_headers h LEFT JOIN attacked_entries e ON e.transaction_id = h.id
WHERE h.state = 'POSTED' GROUP BY h.id, h.type HAVING count(e.id) < 2""")
def _(s):
    return k.ledger_empty_headers(attacks.headers(s), attacks.entries(s))


@query("ledger_account_code_breaks", """SELECT e.id AS entry_id, e.account_id, e.account_code, a.code AS real_code FROM attacked_entries e JOIN attacked_accounts a ON a.id = e.account_id WHERE a.code <> e.account_code""")
def _(s):
    return k.ledger_account_code_breaks(attacks.entries(s), attacks.accounts(s))


@query("ledger_double_reversals", """SELECT reversal_of_transaction_id, count(*) AS reversals FROM attacked_headers WHERE type = 'REVERSAL' AND reversal_of_transaction_id IS NOT NULL
GROUP BY 1 HAVING count(*) > 1""")
def _(s):
    return k.ledger_double_reversals(attacks.headers(s))


@query("ledger_reversal_shape_breaks", """SELECT * FROM (SELECT id, type, CASE WHEN type = 'REVERSAL' AND reversal_of_transaction_id IS NULL THEN 'NO_ORIGINAL'
  WHEN type = 'REVERSAL' AND reversal_reason IS NULL THEN 'NO_REASON' WHEN type <> 'REVERSAL' AND (reversal_of_transaction_id IS NOT NULL OR reversal_reason IS NOT NULL) THEN 'NOT_A_REVERSAL'
  WHEN reversal_of_transaction_id = id THEN 'REVERSES_ITSELF' END AS problem FROM attacked_headers) WHERE problem IS NOT NULL""")
def _(s):
    return k.ledger_reversal_shape_breaks(attacks.headers(s))


@query("ledger_reversal_not_mirror", """SELECT reversal_id, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(unexpected) AS BIGINT) AS unexpected FROM (
SELECT coalesce(o.rid, r.rid) AS reversal_id, greatest(coalesce(o.n, 0) - coalesce(r.n, 0), 0) AS missing, greatest(coalesce(r.n, 0) - coalesce(o.n, 0), 0) AS unexpected
FROM (SELECT h.id AS rid, e.account_id, e.direction, e.amount_minor, count(*) AS n FROM attacked_headers h JOIN attacked_entries e ON e.transaction_id = h.reversal_of_transaction_id WHERE h.type = 'REVERSAL' GROUP BY ALL) o
FULL OUTER JOIN (SELECT h.id AS rid, e.account_id, CASE e.direction WHEN 'DEBIT' THEN 'CREDIT' ELSE 'DEBIT' END AS direction, e.amount_minor, count(*) AS n FROM attacked_headers h JOIN attacked_entries e ON e.transaction_id = h.id
  WHERE h.type = 'REVERSAL' AND h.reversal_of_transaction_id IS NOT NULL GROUP BY ALL) r
ON o.rid = r.rid AND o.account_id = r.account_id AND o.direction = r.direction AND o.amount_minor = r.amount_minor)
GROUP BY reversal_id HAVING sum(missing) + sum(unexpected) > 0""")
def _(s):
    return k.ledger_reversal_not_mirror(attacks.headers(s), attacks.entries(s))


@query("asset_negative_balances", """SELECT * FROM (SELECT e.account_id, e.currency, e.posted_at, e.transaction_id, e.line_no, CASE WHEN e.direction = a.normal_side THEN amount_minor ELSE -amount_minor END AS signed_minor,
  CAST(sum(CASE WHEN e.direction = a.normal_side THEN amount_minor ELSE -amount_minor END) OVER (PARTITION BY e.account_id, e.currency ORDER BY e.posted_at, e.transaction_id, e.line_no, e.id) AS BIGINT) AS balance_minor
FROM attacked_entries e JOIN attacked_accounts a ON a.id = e.account_id WHERE a.account_type = 'ASSET') WHERE balance_minor < 0""")
def _(s):
    return k.asset_negative_balances(attacks.entries(s), attacks.accounts(s))


@query("ledger_double_postings", "SELECT source_type, source_id, type, count(*) AS n FROM attacked_headers WHERE type <> 'REVERSAL' GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(s):
    return k.ledger_double_postings(attacks.headers(s))


CTE["attacked_payout_lines"] = """
SELECT payout_record_id, payment_id, line_net_minor, line_no FROM payout_lines
UNION ALL SELECT 'po_twice_' || merchant_reference, payment_id, line_net_minor, line_no FROM payout_lines WHERE line_no % 43 = 1"""


def payout_lines(s):
    lines = s.payout_lines.select("payout_record_id", "payment_id", "line_net_minor", "line_no", "merchant_reference")
    twice = lines.filter("line_no % 43 = 1").withColumn("payout_record_id", F.concat(F.lit("po_twice_"), "merchant_reference"))
    return lines.unionByName(twice).drop("merchant_reference")


@query("payout_double_payments", "SELECT payment_id, count(*) AS n FROM attacked_payout_lines GROUP BY 1 HAVING count(*) > 1")
def _(s):
    return k.payout_double_payments(payout_lines(s))


@query("payment_row_violations", """SELECT * FROM (SELECT id, state, failure_code, concat_ws(',', CASE WHEN (state = 'FAILED') <> (failure_code IS NOT NULL) THEN 'FAILURE_CODE' END,
  CASE WHEN amount_minor <> net_amount_minor + fee THEN 'SPLIT' END) AS problems
FROM (SELECT id, state, CASE WHEN k % 157 = 20 THEN NULL WHEN k % 163 = 30 THEN 'STRAY' ELSE failure_code END AS failure_code, amount_minor, net_amount_minor,
  platform_fee_minor + CASE WHEN k % 167 = 12 THEN 1 ELSE 0 END AS fee FROM payments)) WHERE problems <> ''""")
def _(s):
    bent = s.payments.withColumns({
        "failure_code": F.expr("case when k % 157 = 20 then null when k % 163 = 30 then 'STRAY' else failure_code end"),
        "platform_fee_minor": F.expr("platform_fee_minor + case when k % 167 = 12 then 1 else 0 end")})
    return k.payment_row_violations(bent)


@query("payout_row_violations", """SELECT id, total_net_minor, lines_net, line_count, lines, problems FROM (
SELECT r.*, coalesce(l.net, 0) AS lines_net, coalesce(l.n, 0) AS lines, concat_ws(',', CASE WHEN status = 'EXECUTED' AND (ledger_transaction_id IS NULL OR executed_at IS NULL) THEN 'EXECUTED_UNPROVEN' END,
  CASE WHEN total_net_minor <> coalesce(l.net, 0) THEN 'TOTAL' END, CASE WHEN line_count <> coalesce(l.n, 0) THEN 'LINE_COUNT' END) AS problems
FROM (SELECT id, status, CASE WHEN total_net_minor % 13 = 1 THEN NULL ELSE ledger_transaction_id END AS ledger_transaction_id, executed_at,
    total_net_minor + CASE WHEN total_net_minor % 17 = 2 THEN 1 ELSE 0 END AS total_net_minor, line_count + CASE WHEN total_net_minor % 19 = 3 THEN 1 ELSE 0 END AS line_count FROM payout_records) r
LEFT JOIN (SELECT payout_record_id, CAST(sum(line_net_minor) AS BIGINT) AS net, count(*) AS n FROM payout_lines GROUP BY 1) l ON l.payout_record_id = r.id) WHERE problems <> ''""")
def _(s):
    bent = s.payout_records.select(
        "id", "status", F.expr("case when total_net_minor % 13 = 1 then null else ledger_transaction_id end").alias("ledger_transaction_id"), "executed_at",
        F.expr("total_net_minor + case when total_net_minor % 17 = 2 then 1 else 0 end").alias("total_net_minor"),
        F.expr("line_count + case when total_net_minor % 19 = 3 then 1 else 0 end").alias("line_count"))
    return k.payout_row_violations(bent, s.payout_lines)


@query("settlement_row_violations", """SELECT * FROM (SELECT id, validity, concat_ws(',', CASE WHEN validity = 'VALID' AND reason IS NOT NULL THEN 'VALID_WITH_REASON' END,
  CASE WHEN validity = 'INVALID' AND reason IS NULL THEN 'INVALID_WITHOUT_REASON' END, CASE WHEN validity = 'VALID' AND gross_amount_minor <> net_amount_minor + fee THEN 'SPLIT' END) AS problems
FROM (SELECT id, validity, gross_amount_minor, net_amount_minor, CASE WHEN gross_amount_minor % 5 = 1 AND validity = 'INVALID' THEN NULL WHEN gross_amount_minor % 7 = 2 AND validity = 'VALID' THEN 'why' ELSE validity_reason END AS reason,
  fee_amount_minor + CASE WHEN gross_amount_minor % 11 = 3 THEN 1 ELSE 0 END AS fee FROM settlement_records)) WHERE problems <> ''""")
def _(s):
    bent = s.settlement_records.withColumns({
        "validity_reason": F.expr("case when gross_amount_minor % 5 = 1 and validity = 'INVALID' then null when gross_amount_minor % 7 = 2 and validity = 'VALID' then 'why' else validity_reason end"),
        "fee_amount_minor": F.expr("fee_amount_minor + case when gross_amount_minor % 11 = 3 then 1 else 0 end")})
    return k.settlement_row_violations(bent)


@query("case_row_violations", f"""SELECT * FROM (SELECT id, status, CASE WHEN status IN ('RESOLVED','WRITTEN_OFF') AND length(coalesce(note, '')) < 20 THEN 'CLOSED_WITHOUT_NOTE'
  WHEN status IN ('RESOLVED','WRITTEN_OFF') AND closed IS NULL THEN 'CLOSED_WITHOUT_TIME' WHEN status IN ('OPEN','INVESTIGATING') AND closed IS NOT NULL THEN 'OPEN_WITH_TIME' END AS problem
FROM (SELECT id, status, CASE WHEN x % 10 = 3 THEN 'short' ELSE 'explained in statement ' || x END AS note,
  CASE WHEN (status IN ('RESOLVED','WRITTEN_OFF') AND x % 17 <> 5) OR (status = 'OPEN' AND x % 19 = 4) THEN detected_at END AS closed
  FROM (SELECT *, {cases._SQLNUM} AS x FROM cases_b))) WHERE problem IS NOT NULL""")
def _(s):
    bent = cases.cases_b(s).withColumn("x", F.expr(cases._NUM)).withColumns({
        "resolution_note": F.expr("case when x % 10 = 3 then 'short' else concat('explained in statement ', x) end"),
        "resolved_at": F.expr("case when (status in ('RESOLVED', 'WRITTEN_OFF') and x % 17 <> 5) or (status = 'OPEN' and x % 19 = 4) then detected_at end")})
    return k.case_row_violations(bent)


# Declared references, vocabularies and keys beside those spelled out below.  Every seventh or so row, by the last character of its id, is
# bent: a parent is missing, a value is foreign, a row comes twice.
_BENT = "ascii(right({0}, 1)) % 7 = 3"

# (child table, row id, column, parent table): the parent's key is id
_REFERENCES = [
    ("payments", "id", "fee_policy_id", "fee_policies"), ("payments", "id", "settlement_record_id", "settlement_records"),
    ("state_history", "id", "payment_id", "payments"), ("ledger_links", "payment_id", "ledger_transaction_id", "ledger_transactions"),
    ("ledger_transactions", "id", "reversal_of_transaction_id", "ledger_transactions"), ("payout_lines", "payout_record_id", "payment_id", "payments"),
    ("payout_records", "id", "ledger_transaction_id", "ledger_transactions"), ("cases_b", "id", "payment_id", "payments"),
    ("cases_b", "id", "batch_id", "batches"), ("cases_b", "id", "result_id", "results_b"), ("case_event_log", "id", "case_id", "cases_b"),
    ("results_b", "id", "batch_id", "batches"), ("results_b", "id", "internal_payment_id", "payments"), ("stored_balances", "account_id", "account_id", "accounts"),
]
_CASE_REASONS = [name for name, *_ in vocab.OUTCOMES]
# (table, row id, column, vocabulary); null is no value
_VOCABULARIES = [
    ("payments", "id", "currency", vocab.CURRENCIES), ("state_history", "id", "from_state", vocab.PAYMENT_STATES), ("state_history", "id", "to_state", vocab.PAYMENT_STATES),
    ("state_history", "id", "trigger_type", vocab.TRIGGER_TYPES), ("ledger_links", "ledger_transaction_id", "role", vocab.LINK_ROLES),
    ("ledger_transactions", "id", "currency", vocab.CURRENCIES), ("ledger_transactions", "id", "state", ["POSTED"]), ("settlement_records", "id", "validity", ["VALID", "INVALID"]),
    ("provider_transactions", "id", "provider_status", vocab.PAYMENT_STATES), ("provider_transactions", "id", "currency", vocab.CURRENCIES),
    ("payout_records", "id", "status", vocab.PAYOUT_STATUSES), ("payout_records", "id", "currency", vocab.CURRENCIES),
    ("fee_policies", "id", "currency", vocab.CURRENCIES), ("accounts", "id", "normal_side", ["DEBIT", "CREDIT"]),
    ("cases_b", "id", "status", vocab.CASE_STATUSES), ("cases_b", "id", "reason", _CASE_REASONS), ("cases_b", "id", "severity", ["LOW", "MEDIUM", "HIGH"]),
    ("classified_deliveries", "id", "outcome", vocab.DELIVERY_OUTCOMES), ("results_b", "id", "outcome", _CASE_REASONS), ("batches", "id", "status", vocab.BATCH_STATUSES),
    ("accounts", "id", "account_type", ["ASSET", "LIABILITY", "REVENUE", "EXPENSE"]), ("accounts", "id", "state", ["ACTIVE", "CLOSED"]),
    ("stored_balances", "account_id", "currency", vocab.CURRENCIES), ("case_event_log", "id", "from_status", vocab.CASE_STATUSES), ("case_event_log", "id", "to_status", vocab.CASE_STATUSES),
    ("provider_transactions", "id", "source", ["WEBHOOK", "PULL", "MANUAL"]), ("audit_events", "id", "actor_type", ["USER", "SERVICE", "WORKER", "WEBHOOK", "SYSTEM"]),
]
# (table, row id that decides on the repetition, key columns)
_KEYS = [
    ("payments", "id", ["id"]), ("ledger_transactions", "id", ["id"]), ("state_history", "id", ["id"]), ("fee_policies", "id", ["code", "currency"]),
    ("accounts", "id", ["code"]), ("payout_records", "id", ["id"]), ("ledger_links", "ledger_transaction_id", ["payment_id", "ledger_transaction_id", "role"]),
    ("provider_transactions", "id", ["id"]), ("cases_b", "id", ["id"]), ("results_b", "id", ["batch_id", "subject_key"]), ("results_b", "id", ["id"]),
    ("provider_events", "delivery_id", ["provider", "event_id"]), ("classified_deliveries", "id", ["id"]), ("stored_balances", "account_id", ["account_id", "currency"]),
    ("case_event_log", "id", ["id"]), ("payout_lines", "payout_record_id", ["payout_record_id", "line_no"]), ("settlement_records", "id", ["id"]), ("batches", "id", ["id"]),
    ("audit_events", "id", ["id"]),
]


def _rows(s: Scenario, name: str) -> DataFrame:
    """A table by its name in SQL, one and the same frame however often it is asked for."""
    made = {
        "cases_b": cases.cases_b, "results_b": matching.results_b, "classified_deliveries": events.classified, "provider_events": events.provider_events,
        "batches": payments.batches, "stored_balances": ledger.stored_balances, "case_event_log": cases.case_event_log, "audit_events": audit_ops.audit_events}
    known = s.__dict__.setdefault("_checked_tables", {})
    if name not in known:
        known[name] = made[name](s) if name in made else getattr(s, name)
    return known[name]


def _reference_sql() -> str:
    return "".join(
        f"""
UNION ALL SELECT '{child}.{column}', c.{row}, c.{column} FROM {child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} t WHERE t.id = c.{column} AND NOT {_BENT.format('t.id')})"""
        for child, row, column, parent in _REFERENCES)


def _vocabulary_sql() -> str:
    return "".join(
        f"""
UNION ALL SELECT '{table}.{column}', {row}, v FROM (SELECT {row}, CASE WHEN {_BENT.format(row)} THEN 'BENT' ELSE {column} END AS v FROM {table}) WHERE v NOT IN ({", ".join(f"'{w}'" for w in words)})"""
        for table, row, column, words in _VOCABULARIES)


def _key_sql() -> str:
    return "".join(
        f"""
UNION ALL SELECT '{table}({", ".join(keys)})', concat_ws('|', {", ".join(keys)}), count(*) FROM (SELECT * FROM {table} UNION ALL SELECT * FROM {table} WHERE {_BENT.format(row)}) GROUP BY 2 HAVING count(*) > 1"""
        for table, row, keys in _KEYS)


@query("foreign_key_orphans", """
SELECT 'ledger_entries.transaction_id' AS relation, e.id AS child_id, e.transaction_id AS missing_parent FROM attacked_entries e WHERE NOT EXISTS (SELECT 1 FROM ledger_transactions t WHERE t.id = e.transaction_id)
UNION ALL SELECT 'ledger_entries.account_id', e.id, e.account_id FROM attacked_entries e WHERE NOT EXISTS (SELECT 1 FROM accounts t WHERE t.id = e.account_id)
UNION ALL SELECT 'ledger_transactions.reversal_of', h.id, h.reversal_of_transaction_id FROM ledger_transactions h WHERE h.reversal_of_transaction_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM attacked_headers t WHERE t.id = h.reversal_of_transaction_id AND t.type = 'PAYMENT_CAPTURE')
UNION ALL SELECT 'payment_ledger_transactions.payment_id', l.ledger_transaction_id, l.payment_id FROM ledger_links l WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.id = l.payment_id AND p.k % 179 <> 3)
UNION ALL SELECT 'provider_transactions.payment_id', r.id, r.payment_id FROM provider_transactions r WHERE r.payment_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM payments p WHERE p.id = r.payment_id AND p.k % 179 <> 3)
UNION ALL SELECT 'settlement_record_lines.settlement_record_id', CAST(l.line_no AS VARCHAR), l.settlement_record_id FROM statement_lines l WHERE NOT EXISTS (SELECT 1 FROM settlement_records r WHERE r.id = l.settlement_record_id AND r.provider_settlement_id NOT LIKE 'set2_%')
UNION ALL SELECT 'payout_lines.payout_record_id', l.payment_id, l.payout_record_id FROM attacked_payout_lines l WHERE NOT EXISTS (SELECT 1 FROM payout_records r WHERE r.id = l.payout_record_id)""" + _reference_sql())
def _(s):
    e, pay = attacks.entries(s), s.payments.filter("k % 179 <> 3")
    parents = {parent: _rows(s, parent).filter("not " + _BENT.format("id")) for *_, parent in _REFERENCES}
    return k.foreign_key_orphans([
        ("ledger_entries.transaction_id", e, F.col("id"), "transaction_id", s.ledger_transactions, "id"),
        ("ledger_entries.account_id", e, F.col("id"), "account_id", s.accounts, "id"),
        ("ledger_transactions.reversal_of", s.ledger_transactions, F.col("id"), "reversal_of_transaction_id",
         attacks.headers(s).filter("type = 'PAYMENT_CAPTURE'"), "id"),
        ("payment_ledger_transactions.payment_id", s.ledger_links, F.col("ledger_transaction_id"), "payment_id", pay, "id"),
        ("provider_transactions.payment_id", s.provider_transactions, F.col("id"), "payment_id", pay, "id"),
        ("settlement_record_lines.settlement_record_id", s.statement_lines, F.col("line_no").cast("string"), "settlement_record_id",
         s.settlement_records.filter("provider_settlement_id not like 'set2_%'"), "id"),
        ("payout_lines.payout_record_id", payout_lines(s), F.col("payment_id"), "payout_record_id", s.payout_records, "id"),
        *[(f"{child}.{column}", _rows(s, child), F.col(row), column, parents[parent], "id") for child, row, column, parent in _REFERENCES],
    ])


@query("unique_key_breaks", """
SELECT 'payments(provider, provider_transaction_id)' AS key_name, provider || '|' || provider_transaction_id AS key_value, count(*) AS n FROM payments WHERE provider_transaction_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'provider_transactions(provider, provider_transaction_id)', provider || '|' || provider_transaction_id, count(*) FROM provider_transactions GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'settlement_records(provider, provider_settlement_id)', provider || '|' || provider_settlement_id, count(*) FROM settlement_records GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'settlement_record_lines(record, line_no)', settlement_record_id || '|' || line_no, count(*) FROM statement_lines GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'ledger_entries(transaction_id, line_no)', transaction_id || '|' || line_no, count(*) FROM attacked_entries GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'payout_lines(payment_id)', payment_id, count(*) FROM attacked_payout_lines GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'reconciliation_cases(open subject, reason)', coalesce(payment_id, '~') || '|' || provider_transaction_id || '|' || reason, count(*) FROM (SELECT * FROM cases_b UNION ALL SELECT * FROM cases_b WHERE occurrence_count > 1) WHERE status IN ('OPEN','INVESTIGATING') GROUP BY 2 HAVING count(*) > 1""" + _key_sql())
def _(s):
    open_cases = cases.cases_b(s).filter("status in ('OPEN', 'INVESTIGATING')").withColumn("payment_key", F.coalesce("payment_id", F.lit("~")))
    # Bent rows come twice from one reading of their table.
    repeated = {table: _rows(s, table).withColumn("_copy", F.explode(F.expr(f"sequence(1, case when {_BENT.format(row)} then 2 else 1 end)")))
                for table, row, _ in _KEYS}
    return k.unique_key_breaks([
        ("payments(provider, provider_transaction_id)", s.payments.filter("provider_transaction_id is not null"), ["provider", "provider_transaction_id"]),
        ("provider_transactions(provider, provider_transaction_id)", s.provider_transactions, ["provider", "provider_transaction_id"]),
        ("settlement_records(provider, provider_settlement_id)", s.settlement_records, ["provider", "provider_settlement_id"]),
        ("settlement_record_lines(record, line_no)", s.statement_lines, ["settlement_record_id", "line_no"]),
        ("ledger_entries(transaction_id, line_no)", attacks.entries(s), ["transaction_id", "line_no"]),
        ("payout_lines(payment_id)", payout_lines(s), ["payment_id"]),
        ("reconciliation_cases(open subject, reason)", open_cases.unionByName(open_cases.filter("occurrence_count > 1")), ["payment_key", "provider_transaction_id", "reason"]),
        *[(f"{table}({', '.join(keys)})", repeated[table], keys) for table, row, keys in _KEYS],
    ])


@query("history_mutations", """SELECT id, CASE WHEN CAST(substring(payment_id, 5) AS BIGINT) % 127 = 2 THEN 'DELETED' ELSE 'CHANGED' END AS mutation FROM state_history
WHERE CAST(substring(payment_id, 5) AS BIGINT) % 127 = 2 OR (CAST(substring(payment_id, 5) AS BIGINT) % 113 = 1 AND trigger_type <> 'SYSTEM')""")
def _(s):
    after = s.state_history.withColumn("kk", F.expr("cast(substring(payment_id, 5) as bigint)")).filter("kk % 127 <> 2").withColumn(
        "trigger_type", F.expr("case when kk % 113 = 1 then 'SYSTEM' else trigger_type end")).drop("kk")
    added = s.state_history.withColumn("id", F.concat("id", F.lit("_new")))
    return k.history_mutations(s.state_history, after.unionByName(added))


@query("enum_violations", """
SELECT 'ledger_transactions.type' AS column_name, id AS row_id, type AS value FROM attacked_headers WHERE type NOT IN ('PAYMENT_CAPTURE','REVERSAL','PAYMENT_REFUND_SETTLED','SETTLEMENT_RECEIVED','MERCHANT_PAYOUT','PSP_ADJUSTMENT')
UNION ALL SELECT 'ledger_transactions.source_type', id, source_type FROM attacked_headers WHERE source_type NOT IN ('PAYMENT','SETTLEMENT_RECORD','PAYOUT','RECONCILIATION_CASE','SYSTEM')
UNION ALL SELECT 'ledger_entries.direction', id, direction FROM attacked_entries WHERE direction NOT IN ('DEBIT','CREDIT')
UNION ALL SELECT 'ledger_entries.currency', id, currency FROM attacked_entries WHERE currency NOT IN ('EGP','USD','EUR','GBP')
UNION ALL SELECT 'settlement_records.currency', id, currency FROM settlement_records WHERE currency NOT IN ('EGP','USD','EUR','GBP')
UNION ALL SELECT 'payments.state', id, s FROM (SELECT id, CASE WHEN k % 181 = 4 THEN 'LIMBO' ELSE state END AS s FROM payments) WHERE s NOT IN ('CREATED','AUTHORIZED','CAPTURED','SETTLED','FAILED','REFUNDED')""" + _vocabulary_sql())
def _(s):
    h, e = attacks.headers(s), attacks.entries(s)
    return k.enum_violations([
        ("ledger_transactions.type", h, "id", "type", vocab.LEDGER_TYPES),
        ("ledger_transactions.source_type", h, "id", "source_type", vocab.SOURCE_TYPES),
        ("ledger_entries.direction", e, "id", "direction", ["DEBIT", "CREDIT"]),
        ("ledger_entries.currency", e, "id", "currency", vocab.CURRENCIES),
        ("settlement_records.currency", s.settlement_records, "id", "currency", vocab.CURRENCIES),
        ("payments.state", _rows(s, "payments"), "id", F.expr("case when k % 181 = 4 then 'LIMBO' else state end"), vocab.PAYMENT_STATES),
        *[(f"{table}.{column}", _rows(s, table), row, F.expr(f"case when {_BENT.format(row)} then 'BENT' else {column} end"), words)
          for table, row, column, words in _VOCABULARIES],
    ])
