"""Registered case queries.

Batch A opens cases, operators work on them by rule, then batch B meets the same problems again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark import vocab
from settlespark.operators import cases as c
from settlespark.plans import matching
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query
from settlespark.sources.scenario import Scenario, WINDOW_A, WINDOW_B

AT_A, AT_B = "2002-01-01 00:00:00", "2002-01-02 00:00:00"

# The number in a case's transaction id decides what operators do with it.
_NUM = "cast(regexp_extract(provider_transaction_id, '([0-9]+)$', 1) as bigint)"
_SQLNUM = "CAST(regexp_extract(provider_transaction_id, '([0-9]+)$', 1) AS BIGINT)"

CTE["cases_a"] = f"""
SELECT 'rcs_' || r.id AS id, batch_id, r.id AS result_id, internal_payment_id AS payment_id, provider, provider_transaction_id, r.outcome AS reason, o.severity,
  CASE {_SQLNUM} % 7 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'WRITTEN_OFF' ELSE 'OPEN' END AS status,
  CAST(1 AS BIGINT) AS occurrence_count, TIMESTAMP '{AT_A}' AS detected_at
FROM results_a r JOIN outcomes o ON o.outcome = r.outcome AND o.requires_case"""

CTE["detected_b"] = """
SELECT r.batch_id, r.id AS result_id, r.subject_key, r.internal_payment_id AS payment_id, r.provider, r.provider_transaction_id, r.outcome AS reason, o.severity,
  k.id AS known_id, k.status AS known_status, k.id IS NOT NULL AS reused, coalesce(k.id, 'rcs_' || r.id) AS case_id
FROM results_b r JOIN outcomes o ON o.outcome = r.outcome AND o.requires_case
LEFT JOIN cases_a k ON coalesce(k.payment_id, '~') = coalesce(r.internal_payment_id, '~') AND k.provider = r.provider
  AND k.provider_transaction_id = r.provider_transaction_id AND k.reason = r.outcome"""

CTE["cases_b"] = f"""
SELECT a.id, a.batch_id, a.result_id, a.payment_id, a.provider, a.provider_transaction_id, a.reason, a.severity, a.status,
  a.occurrence_count + CASE WHEN d.known_id IS NULL THEN 0 ELSE 1 END AS occurrence_count, a.detected_at
FROM cases_a a LEFT JOIN (SELECT DISTINCT known_id FROM detected_b WHERE reused) d ON d.known_id = a.id
UNION ALL
SELECT case_id, batch_id, result_id, payment_id, provider, provider_transaction_id, reason, severity, 'OPEN', 1, TIMESTAMP '{AT_B}'
FROM detected_b WHERE NOT reused"""

CTE["case_commands"] = f"""
SELECT id AS case_id, CAST(s.seq AS BIGINT) AS seq,
  CASE WHEN s.seq = 1 THEN 'INVESTIGATE' WHEN s.seq = 2 THEN CASE WHEN x % 3 = 0 THEN 'WRITE_OFF' ELSE 'RESOLVE' END
       WHEN s.seq = 3 THEN 'INVESTIGATE' ELSE 'RESOLVE' END AS command,
  CASE WHEN x % 5 = 0 AND s.seq = 1 THEN ' ' ELSE 'ops-' || x % 9 END AS assigned_to,
  CASE WHEN x % 4 = 0 AND s.seq = 2 THEN '  too short  ' ELSE 'checked against statement ' || x END AS note,
  CASE WHEN x % 6 = 0 THEN 'SHRUG' WHEN x % 2 = 0 THEN 'OTHER' ELSE 'TIMING_DIFFERENCE' END AS action
FROM (SELECT id, {_SQLNUM} AS x FROM cases_b) JOIN (VALUES (1), (2), (3), (4)) s(seq) ON true"""

CTE["cases_numbered"] = "SELECT *, row_number() OVER (ORDER BY detected_at, id) AS case_number FROM cases_b"


def results_of(s: Scenario, batch: str) -> DataFrame:
    """Gold results of a batch, stored once like the append-only table they are."""
    window = {"a": WINDOW_A, "b": WINDOW_B}[batch]
    return s.keep(f"results_{batch}", lambda: matching.results(s, window, f"rbat_{batch}"))


def cases_a(s: Scenario) -> DataFrame:
    def build():
        raised = results_of(s, "a").join(vocab.outcome_map(s.spark).filter("requires_case"), "outcome")
        return raised.select(
            F.concat(F.lit("rcs_"), "id").alias("id"), "batch_id", F.col("id").alias("result_id"),
            F.col("internal_payment_id").alias("payment_id"), "provider", "provider_transaction_id", F.col("outcome").alias("reason"), "severity",
            F.expr(f"case {_NUM} % 7 when 0 then 'RESOLVED' when 1 then 'INVESTIGATING' when 2 then 'WRITTEN_OFF' else 'OPEN' end").alias("status"),
            F.lit(1).cast("bigint").alias("occurrence_count"), F.lit(AT_A).cast("timestamp_ntz").alias("detected_at"))
    return s.keep("cases_a", build)


def detected_b(s: Scenario) -> DataFrame:
    return c.detections(results_of(s, "b"), cases_a(s))


def cases_b(s: Scenario) -> DataFrame:
    return s.keep("cases_b", lambda: c.cases_from_detections(detected_b(s), cases_a(s), AT_B))


def case_commands(s: Scenario) -> DataFrame:
    x = cases_b(s).select("id", F.expr(_NUM).alias("x"), F.explode(F.expr("sequence(1, 4)")).alias("n"))
    return x.select(
        F.col("id").alias("case_id"), F.col("n").cast("bigint").alias("seq"),
        F.expr("case when n in (1, 3) then 'INVESTIGATE' when n = 2 and x % 3 = 0 then 'WRITE_OFF' else 'RESOLVE' end").alias("command"),
        F.expr("case when x % 5 = 0 and n = 1 then ' ' else concat('ops-', x % 9) end").alias("assigned_to"),
        F.expr("case when x % 4 = 0 and n = 2 then '  too short  ' else concat('checked against statement ', x) end").alias("note"),
        F.expr("case when x % 6 = 0 then 'SHRUG' when x % 2 = 0 then 'OTHER' else 'TIMING_DIFFERENCE' end").alias("action"))


@query("open_cases_from_results", "SELECT * FROM cases_b")
def _(s):
    return c.cases_from_detections(detected_b(s), cases_a(s), AT_B)


@query("case_events_from_results", """SELECT 'cev_' || result_id AS id, case_id, coalesce(known_status, 'OPEN') AS from_status, coalesce(known_status, 'OPEN') AS to_status,
  CASE WHEN reused THEN 're-detected: ' || reason || ' (no status change; occurrence only)' ELSE 'opened: ' || reason END AS note FROM detected_b""")
def _(s):
    return c.case_events_from_results(detected_b(s))


# The command fold step by step: four commands per case, each meeting the status the one before left.
def _step(n: int) -> str:
    before = "s.status" if n == 1 else "s.status_after"
    source = "SELECT id AS case_id, status FROM cases_b" if n == 1 else f"SELECT case_id, status_after FROM command_step_{n - 1}"
    return f"""
SELECT case_id, seq, command, verdict, met AS status_before, CASE WHEN verdict <> 'ACCEPTED' THEN met WHEN command = 'INVESTIGATE' THEN 'INVESTIGATING'
    WHEN command = 'RESOLVE' THEN 'RESOLVED' ELSE 'WRITTEN_OFF' END AS status_after
FROM (SELECT m.case_id, m.seq, m.command, {before} AS met, CASE
    WHEN command = 'INVESTIGATE' AND trim(assigned_to) = '' THEN 'OWNER_REQUIRED'
    WHEN command <> 'INVESTIGATE' AND length(trim(note)) < 20 THEN 'NOTE_TOO_SHORT'
    WHEN command = 'WRITE_OFF' AND action NOT IN ('OTHER', 'TIMING_DIFFERENCE') THEN 'ACTION_REQUIRED'
    WHEN command = 'INVESTIGATE' AND {before} <> 'OPEN' THEN 'INVALID_TRANSITION'
    WHEN {before} NOT IN ('OPEN', 'INVESTIGATING') THEN 'INVALID_TRANSITION' ELSE 'ACCEPTED' END AS verdict
  FROM case_commands m JOIN ({source}) s ON s.case_id = m.case_id WHERE m.seq = {n})"""


for _n in (1, 2, 3, 4):
    CTE[f"command_step_{_n}"] = _step(_n)


@query("apply_case_commands", " UNION ALL ".join(f"SELECT * FROM command_step_{n}" for n in (1, 2, 3, 4)))
def _(s):
    return c.apply_case_commands(cases_b(s), case_commands(s))


@query("verify_case_adjustments", f"""SELECT x.case_id, x.adjustment_id, x.payment_id, CASE WHEN t.id IS NULL THEN 'DOES_NOT_EXIST' WHEN t.state <> 'POSTED' THEN 'NOT_POSTED'
    WHEN x.payment_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ledger_links l WHERE l.payment_id = x.payment_id AND l.ledger_transaction_id = x.adjustment_id) THEN 'DOES_NOT_TOUCH_PAYMENT' ELSE 'OK' END AS verdict
FROM (SELECT id AS case_id, payment_id, 'ltx_cap_pay_' || ({_SQLNUM} + CASE WHEN {_SQLNUM} % 3 = 1 THEN 1 ELSE 0 END) AS adjustment_id FROM cases_b) x
LEFT JOIN ledger_transactions t ON t.id = x.adjustment_id""")
def _(s):
    cited = cases_b(s).select(F.col("id").alias("case_id"), F.expr(
        f"concat('ltx_cap_pay_', {_NUM} + case when {_NUM} % 3 = 1 then 1 else 0 end)").alias("adjustment_id"))
    return c.verify_case_adjustments(cited, cases_b(s), s.ledger_transactions, s.ledger_links)


@query("open_cases", """SELECT id, 'RC-' || case_number AS case_ref, payment_id, provider_transaction_id, reason, severity, status, occurrence_count, detected_at
FROM cases_numbered WHERE status IN ('OPEN', 'INVESTIGATING')
ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, detected_at, id""")
def _(s):
    return c.open_cases(c.case_numbers(cases_b(s)))


CTE["case_event_log"] = f"""
SELECT 'cev_' || id || '_' || n AS id, id AS case_id, CAST(n AS BIGINT) AS seq,
  CASE WHEN n = 1 THEN 'OPEN' WHEN n = 2 THEN CASE WHEN x % 11 = 3 THEN 'RESOLVED' ELSE 'OPEN' END ELSE CASE WHEN x % 13 = 5 THEN 'OPEN' ELSE 'INVESTIGATING' END END AS from_status,
  CASE WHEN n = 1 THEN 'OPEN' WHEN n = 2 THEN 'INVESTIGATING' ELSE 'RESOLVED' END AS to_status
FROM (SELECT id, {_SQLNUM} AS x FROM cases_b) JOIN (VALUES (1), (2), (3)) s(n) ON true"""


def case_event_log(s) -> DataFrame:
    return cases_b(s).select(F.col("id").alias("cid"), F.expr(_NUM).alias("x"), F.explode(F.expr("sequence(1, 3)")).alias("n")).select(
        F.expr("concat('cev_', cid, '_', n)").alias("id"), F.col("cid").alias("case_id"), F.col("n").cast("bigint").alias("seq"),
        F.expr("case when n = 1 then 'OPEN' when n = 2 then case when x % 11 = 3 then 'RESOLVED' else 'OPEN' end "
               "else case when x % 13 = 5 then 'OPEN' else 'INVESTIGATING' end end").alias("from_status"),
        F.expr("case when n = 1 then 'OPEN' when n = 2 then 'INVESTIGATING' else 'RESOLVED' end").alias("to_status"))


@query("case_history_breaks", """SELECT id, case_id, seq, from_status, previous_to, to_status FROM (
  SELECT *, lag(to_status) OVER w AS previous_to, row_number() OVER w AS rn FROM case_event_log WINDOW w AS (PARTITION BY case_id ORDER BY seq, id))
WHERE rn > 1 AND from_status IS DISTINCT FROM previous_to""")
def _(s):
    return c.case_history_breaks(case_event_log(s))


@query("batch_summary", f"""SELECT s.*, c.cases_opened, c.cases_reused FROM ({matching.SUMMARY_SQL.format(src='results_b')}) s
JOIN (SELECT batch_id, count(*) FILTER (NOT reused) AS cases_opened, count(*) FILTER (reused) AS cases_reused FROM detected_b GROUP BY batch_id) c ON c.batch_id = s.batch_id""")
def _(s):
    return matching.m.batch_summary(results_of(s, "b")).join(c.detection_counts(detected_b(s)), "batch_id")
