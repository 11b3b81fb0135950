"""The scenario's rules and shared views once more, as SQL for an independent engine.

``sql(body)`` puts in front of ``body`` the common table expressions it names, directly or through others.
"""

from __future__ import annotations

import re

from settlespark.sources.scenario import RETENTION_DAYS, WEBHOOK_SECRET

_key = WEBHOOK_SECRET.encode().ljust(64, b"\0")
_INNER = "".join(f"{b ^ 0x36:02x}" for b in _key)
_OUTER = "".join(f"{b ^ 0x5C:02x}" for b in _key)

CTE: dict[str, str] = {}

CTE["base_orders"] = """
SELECT o_orderkey AS k, o_custkey AS cu, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS g, o_orderdate AS od,
  CASE o_custkey % 4 WHEN 0 THEN 'EGP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS ccy,
  CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey - 1 ELSE o_orderkey END AS p
FROM orders"""

CTE["payments"] = """
SELECT 'pay_' || k AS id, k, cu, 'MERCH-' || cu AS merchant_reference, g AS amount_minor, ccy AS currency,
  fee AS platform_fee_minor, g - fee AS net_amount_minor,
  CASE WHEN ccy = 'USD' THEN 'fp_usd' ELSE 'fp_default' END AS fee_policy_id, state,
  CASE WHEN state = 'FAILED' THEN 'CARD_DECLINED' END AS failure_code,
  provider, ptx AS provider_transaction_id,
  CASE WHEN settled AND ptx IS NOT NULL THEN 'srec_' || provider || '_' || ccy || '_' || (year(cap) * 100 + month(cap)) END AS settlement_record_id,
  cap AS captured_at,
  CASE WHEN settled THEN CAST(last_day(cap) + 1 AS TIMESTAMP) END AS settled_at,
  CASE WHEN k % 20 >= 8 AND k % 3 = 0 THEN TIMESTAMP '2001-12-01 00:00:00' END AS paid_out_at,
  od + INTERVAL 7 DAY AS expires_at, od AS created_at
FROM (SELECT *, (g * (CASE WHEN ccy = 'USD' THEN 250 ELSE 300 END) + 5000) // 10000 AS fee,
        CASE WHEN p % 5 = 4 THEN 'PSP_B' ELSE 'SIMULATED_PSP' END AS provider,
        CASE WHEN k % 41 <> 0 THEN 'psp_' || p END AS ptx,
        CASE WHEN k % 20 >= 3 THEN od + to_hours(k % 24) END AS cap,
        (k % 20 = 4 OR k % 20 >= 8) AS settled,
        CASE WHEN k % 20 = 0 THEN 'FAILED' WHEN k % 20 = 1 THEN 'CREATED' WHEN k % 20 = 2 THEN 'AUTHORIZED'
             WHEN k % 20 IN (3, 4) THEN 'REFUNDED' WHEN k % 20 IN (5, 6, 7) THEN 'CAPTURED' ELSE 'SETTLED' END AS state
      FROM base_orders)"""

CTE["fee_policies"] = """
SELECT * FROM (VALUES ('fp_default','DEFAULT',300,'EGP',true), ('fp_usd','USD_STANDARD',250,'USD',true),
  ('fp_gbp','GBP_RETIRED',200,'GBP',false)) t(id, code, bps, currency, active)"""

CTE["accounts"] = """
SELECT * FROM (VALUES
  ('acct_psp_clearing','PSP_CLEARING','Receivable from the PSP','ASSET','DEBIT','ACTIVE'),
  ('acct_platform_cash','PLATFORM_CASH','Platform cash','ASSET','DEBIT','ACTIVE'),
  ('acct_merchant_payable','MERCHANT_PAYABLE','Amount owed to merchants','LIABILITY','CREDIT','ACTIVE'),
  ('acct_platform_fee_rev','PLATFORM_FEE_REVENUE','Platform fee revenue','REVENUE','CREDIT','ACTIVE'),
  ('acct_psp_fee_exp','PSP_FEE_EXPENSE','Fees charged by the PSP','EXPENSE','DEBIT','ACTIVE')
) t(id, code, name, account_type, normal_side, state)"""

CTE["covered"] = """
SELECT *, k = first_value(k) OVER (PARTITION BY settlement_record_id ORDER BY k) AND v IN (4, 5) AS first_line
FROM (SELECT *, (year(captured_at) * 12 + month(captured_at)) % 24 AS v FROM payments WHERE settlement_record_id IS NOT NULL)"""

CTE["month_statements"] = """
SELECT settlement_record_id AS id, provider, 'set_' || substring(settlement_record_id, 6) AS provider_settlement_id,
  CAST(CASE v WHEN 1 THEN sum(amount_minor) + 100 WHEN 6 THEN -1 ELSE sum(amount_minor) END AS BIGINT) AS gross_amount_minor,
  CAST(CASE v WHEN 1 THEN sum(platform_fee_minor) + 100 WHEN 2 THEN sum(platform_fee_minor) + 100 WHEN 3 THEN sum(platform_fee_minor) + 1 ELSE sum(platform_fee_minor) END AS BIGINT) AS fee_amount_minor,
  CAST(CASE v WHEN 2 THEN sum(net_amount_minor) - 100 ELSE sum(net_amount_minor) END AS BIGINT) AS net_amount_minor,
  CASE WHEN v = 7 THEN 'JPY' WHEN v <> 8 THEN currency WHEN currency = 'EGP' THEN 'USD' ELSE 'EGP' END AS currency,
  min(last_day(captured_at)) AS settlement_date, v
FROM covered GROUP BY settlement_record_id, provider, currency, v"""

CTE["statements"] = """
SELECT id, provider, provider_settlement_id, gross_amount_minor, fee_amount_minor, net_amount_minor, currency, settlement_date FROM month_statements
UNION ALL
SELECT 'srec2_' || substring(id, 6), provider, 'set2_' || substring(id, 6), gross_amount_minor, fee_amount_minor, net_amount_minor, currency, settlement_date + 3
FROM month_statements WHERE v = 10
UNION ALL
SELECT 'srec_o' || k, provider, 'set_o' || k, amount_minor, platform_fee_minor, net_amount_minor, currency, CAST(created_at AS DATE)
FROM payments WHERE k % 53 = 7 AND k % 4 = 0"""

CTE["statement_lines"] = """
SELECT settlement_record_id, provider_transaction_id, amount_minor AS line_gross_minor,
  CASE WHEN v = 5 AND first_line THEN amount_minor + 1 ELSE net_amount_minor END AS line_net_minor, 2 * k AS line_no
FROM covered WHERE v <> 9
UNION ALL
SELECT settlement_record_id, provider_transaction_id, amount_minor, net_amount_minor, 2 * k + 1 FROM covered WHERE v = 4 AND first_line
UNION ALL
SELECT 'srec2_' || substring(settlement_record_id, 6), provider_transaction_id, amount_minor, net_amount_minor, 2 * k FROM covered WHERE v = 10
UNION ALL
SELECT 'srec_o' || k, 'psp_orphan_' || k, amount_minor, net_amount_minor, 2 * k FROM payments WHERE k % 53 = 7 AND k % 4 = 0"""

CTE["line_totals"] = """
SELECT settlement_record_id, CAST(sum(line_gross_minor) AS BIGINT) AS line_gross, CAST(sum(line_net_minor) AS BIGINT) AS line_net,
  CAST(sum(line_gross_minor) - sum(line_net_minor) AS BIGINT) AS line_fee, count(*) AS line_count
FROM statement_lines GROUP BY settlement_record_id"""

CTE["ranked_bad"] = """
SELECT l.*, row_number() OVER (PARTITION BY settlement_record_id ORDER BY line_no) AS rn FROM statement_lines l
WHERE line_gross_minor < 0 OR line_net_minor < 0 OR line_net_minor > line_gross_minor"""

CTE["ranked_cross"] = """
SELECT l.settlement_record_id, l.provider_transaction_id, min(p.currency) AS ccy,
  row_number() OVER (PARTITION BY l.settlement_record_id ORDER BY min(l.line_no)) AS rn
FROM statement_lines l JOIN statements s ON s.id = l.settlement_record_id
JOIN payments p ON p.provider = s.provider AND p.provider_transaction_id = l.provider_transaction_id AND p.currency <> s.currency
GROUP BY l.settlement_record_id, l.provider_transaction_id"""

CTE["ranked_twice"] = """
SELECT settlement_record_id, provider_transaction_id, count(*) AS n,
  row_number() OVER (PARTITION BY settlement_record_id ORDER BY min(line_no)) AS rn
FROM statement_lines GROUP BY settlement_record_id, provider_transaction_id HAVING count(*) > 1"""

CTE["problem_texts"] = """
SELECT s.id, concat_ws('; ',
  CASE WHEN gross_amount_minor <> line_gross THEN 'gross ' || gross_amount_minor || ' against ' || line_count || ' lines with ' || line_gross END,
  CASE WHEN net_amount_minor <> line_net THEN 'net ' || net_amount_minor || ' against ' || line_net END,
  CASE WHEN fee_amount_minor <> line_fee THEN 'fee ' || fee_amount_minor || ' against ' || line_fee || ' (gross ' || line_gross || ' − net ' || line_net || ')' END) AS problems
FROM statements s JOIN line_totals t ON t.settlement_record_id = s.id"""

CTE["verdict_rules"] = """
SELECT s.*, t.line_count, b.provider_transaction_id AS bad_txn, b.line_gross_minor AS bad_gross, b.line_net_minor AS bad_net,
  c.provider_transaction_id AS cross_txn, c.ccy AS cross_ccy, w.provider_transaction_id AS twice_txn, w.n AS twice_n, x.problems,
  CASE WHEN t.line_count IS NULL THEN 'S1'
    WHEN gross_amount_minor < 0 OR fee_amount_minor < 0 OR net_amount_minor < 0 THEN 'S7'
    WHEN b.line_gross_minor < 0 OR b.line_net_minor < 0 THEN 'S7'
    WHEN b.settlement_record_id IS NOT NULL THEN 'S5'
    WHEN upper(trim(s.currency)) NOT IN ('EGP','USD','EUR','GBP') THEN 'S8'
    WHEN c.settlement_record_id IS NOT NULL THEN 'S9'
    WHEN w.settlement_record_id IS NOT NULL THEN 'S6'
    WHEN x.problems <> '' THEN 'S2-S4' ELSE '-' END AS rule
FROM statements s
LEFT JOIN line_totals t ON t.settlement_record_id = s.id
LEFT JOIN ranked_bad b ON b.settlement_record_id = s.id AND b.rn = 1
LEFT JOIN ranked_cross c ON c.settlement_record_id = s.id AND c.rn = 1
LEFT JOIN ranked_twice w ON w.settlement_record_id = s.id AND w.rn = 1
LEFT JOIN problem_texts x ON x.id = s.id"""

CTE["verdict_texts"] = """
SELECT *, 'settlement ' || provider_settlement_id || CASE rule
  WHEN 'S1' THEN ': no lines'
  WHEN 'S7' THEN CASE WHEN gross_amount_minor < 0 OR fee_amount_minor < 0 OR net_amount_minor < 0
    THEN ': total below zero, gross ' || gross_amount_minor || ', fee ' || fee_amount_minor || ', net ' || net_amount_minor
    ELSE ' line ' || bad_txn || ': amount below zero, gross ' || bad_gross || ', net ' || bad_net END
  WHEN 'S5' THEN ' line ' || bad_txn || ': net ' || bad_net || ' above gross ' || bad_gross
  WHEN 'S8' THEN ': unsupported currency ' || currency
  WHEN 'S9' THEN ': ' || currency || ' settlement, transaction ' || cross_txn || ' belongs to a ' || cross_ccy || ' payment'
  WHEN 'S6' THEN ': transaction ' || twice_txn || ' listed ' || twice_n || ' times'
  WHEN 'S2-S4' THEN ': totals differ, ' || problems END AS reason
FROM verdict_rules"""

CTE["verdicts"] = """
SELECT id, CASE WHEN rule = '-' THEN 'VALID' ELSE 'INVALID' END AS validity, rule,
  reason AS validity_reason
FROM verdict_texts"""

CTE["settlement_records"] = "SELECT s.*, v.validity, v.validity_reason FROM statements s JOIN verdicts v ON v.id = s.id"

CTE["provider_transactions"] = """
SELECT 'ptx_' || k || CASE WHEN c.copy = 2 THEN '_b' ELSE '' END AS id, provider, provider_transaction_id, id AS payment_id,
  CASE WHEN k % 29 = 5 THEN 'MERCH-OTHER' ELSE merchant_reference END AS merchant_reference,
  CASE WHEN k % 29 = 1 THEN amount_minor - 300 ELSE amount_minor END AS gross_amount_minor,
  CASE WHEN k % 29 = 2 THEN platform_fee_minor + 300 ELSE platform_fee_minor END AS fee_amount_minor,
  CASE WHEN k % 29 IN (1, 2) THEN net_amount_minor - 300 ELSE net_amount_minor END AS net_amount_minor,
  CASE WHEN k % 29 <> 3 THEN currency WHEN currency = 'EGP' THEN 'USD' ELSE 'EGP' END AS currency,
  CASE WHEN k % 29 = 4 THEN 'CAPTURED' WHEN k % 20 IN (3, 4) THEN 'REFUNDED' WHEN k % 20 >= 8 THEN 'SETTLED' ELSE 'CAPTURED' END AS provider_status,
  'WEBHOOK' AS source, coalesce(captured_at, created_at) AS captured_at
FROM payments JOIN (VALUES (1), (2)) c(copy) ON c.copy = 1 OR k % 29 = 6
WHERE provider_transaction_id IS NOT NULL AND k % 97 <> 5 AND (k % 20 >= 3 OR k % 40 = 0) AND k % 29 <> 0
UNION ALL
SELECT 'ptx_o' || k, provider, 'psp_orphan_' || k, NULL, 'UNKNOWN', amount_minor, platform_fee_minor, net_amount_minor, currency,
  'SETTLED', 'WEBHOOK', CASE WHEN k % 2 = 1 THEN created_at END
FROM payments WHERE k % 53 = 7"""

CTE["payout_lines"] = """
SELECT 'po_' || cu || '_' || currency AS payout_record_id, id AS payment_id, net_amount_minor AS line_net_minor, k + 1 AS line_no,
  merchant_reference, currency, paid_out_at
FROM payments WHERE paid_out_at IS NOT NULL"""

CTE["payout_records"] = """
SELECT payout_record_id AS id, merchant_reference, currency, CAST(sum(line_net_minor) AS BIGINT) AS total_net_minor, count(*) AS line_count,
  'EXECUTED' AS status, 'ltx_po_' || payout_record_id AS ledger_transaction_id, min(paid_out_at) AS executed_at
FROM payout_lines GROUP BY payout_record_id, merchant_reference, currency"""

CTE["settled_gross"] = """
SELECT settlement_record_id AS id, currency, CAST(sum(amount_minor) AS BIGINT) AS g FROM payments
WHERE settlement_record_id IS NOT NULL GROUP BY settlement_record_id, currency"""

CTE["ledger_transactions"] = """
SELECT 'ltx_cap_' || id AS id, 'PAYMENT_CAPTURE' AS type, 'POSTED' AS state, currency, 'PAYMENT' AS source_type, id AS source_id,
  'Capture of payment ' || id AS description, CAST(NULL AS VARCHAR) AS reversal_of_transaction_id, CAST(NULL AS VARCHAR) AS reversal_reason, captured_at AS posted_at
FROM payments WHERE captured_at IS NOT NULL
UNION ALL
SELECT 'ltx_rev_' || id, 'REVERSAL', 'POSTED', currency, 'PAYMENT', id, 'Reversal of ltx_cap_' || id, 'ltx_cap_' || id,
  'refund of ' || id || ' before settlement', captured_at + INTERVAL 1 DAY FROM payments WHERE k % 20 = 3
UNION ALL
SELECT 'ltx_ref_' || id, 'PAYMENT_REFUND_SETTLED', 'POSTED', currency, 'PAYMENT', id, 'Refund of settled payment ' || id, NULL, NULL,
  captured_at + INTERVAL 40 DAY FROM payments WHERE k % 20 = 4
UNION ALL
SELECT 'ltx_set_' || r.id, 'SETTLEMENT_RECEIVED', 'POSTED', g.currency, 'SETTLEMENT_RECORD', r.id, 'Settlement received from the PSP', NULL, NULL,
  CAST(r.settlement_date AS TIMESTAMP) FROM settlement_records r JOIN settled_gross g ON g.id = r.id WHERE r.validity = 'VALID'
UNION ALL
SELECT 'ltx_po_' || id, 'MERCHANT_PAYOUT', 'POSTED', currency, 'PAYOUT', id, 'Payout to merchant ' || merchant_reference, NULL, NULL, executed_at
FROM payout_records"""

CTE["ledger_legs"] = """
SELECT 'ltx_cap_' || id AS tx, 1 AS no, 'PSP_CLEARING' AS acc, 'DEBIT' AS dir, amount_minor AS amt FROM payments WHERE captured_at IS NOT NULL
UNION ALL SELECT 'ltx_cap_' || id, 2, 'MERCHANT_PAYABLE', 'CREDIT', net_amount_minor FROM payments WHERE captured_at IS NOT NULL
UNION ALL SELECT 'ltx_cap_' || id, 3, 'PLATFORM_FEE_REVENUE', 'CREDIT', platform_fee_minor FROM payments WHERE captured_at IS NOT NULL
UNION ALL SELECT 'ltx_rev_' || id, 1, 'PSP_CLEARING', 'CREDIT', amount_minor FROM payments WHERE k % 20 = 3
UNION ALL SELECT 'ltx_rev_' || id, 2, 'MERCHANT_PAYABLE', 'DEBIT', net_amount_minor FROM payments WHERE k % 20 = 3
UNION ALL SELECT 'ltx_rev_' || id, 3, 'PLATFORM_FEE_REVENUE', 'DEBIT', platform_fee_minor FROM payments WHERE k % 20 = 3
UNION ALL SELECT 'ltx_ref_' || id, 1, 'MERCHANT_PAYABLE', 'DEBIT', net_amount_minor FROM payments WHERE k % 20 = 4
UNION ALL SELECT 'ltx_ref_' || id, 2, 'PLATFORM_FEE_REVENUE', 'DEBIT', platform_fee_minor FROM payments WHERE k % 20 = 4
UNION ALL SELECT 'ltx_ref_' || id, 3, 'PLATFORM_CASH', 'CREDIT', amount_minor FROM payments WHERE k % 20 = 4
UNION ALL SELECT 'ltx_set_' || r.id, 1, 'PLATFORM_CASH', 'DEBIT', g.g FROM settlement_records r JOIN settled_gross g ON g.id = r.id WHERE r.validity = 'VALID'
UNION ALL SELECT 'ltx_set_' || r.id, 2, 'PSP_CLEARING', 'CREDIT', g.g FROM settlement_records r JOIN settled_gross g ON g.id = r.id WHERE r.validity = 'VALID'
UNION ALL SELECT 'ltx_po_' || id, 1, 'MERCHANT_PAYABLE', 'DEBIT', total_net_minor FROM payout_records
UNION ALL SELECT 'ltx_po_' || id, 2, 'PLATFORM_CASH', 'CREDIT', total_net_minor FROM payout_records"""

CTE["ledger_entries"] = """
SELECT 'le_' || tx || '_' || no AS id, tx AS transaction_id, a.id AS account_id, dir AS direction, amt AS amount_minor, t.currency,
  acc AS account_code, CAST(no AS BIGINT) AS line_no, t.posted_at
FROM ledger_legs l JOIN ledger_transactions t ON t.id = l.tx JOIN accounts a ON a.code = l.acc"""

CTE["ledger_links"] = """
SELECT source_id AS payment_id, id AS ledger_transaction_id,
  CASE type WHEN 'PAYMENT_CAPTURE' THEN 'CAPTURE' WHEN 'REVERSAL' THEN 'REVERSAL' ELSE 'REFUND' END AS role
FROM ledger_transactions WHERE source_type = 'PAYMENT'"""

CTE["state_history"] = """
SELECT 'psh_' || k || '_' || n AS id, pid AS payment_id, f AS from_state, t AS to_state, trig AS trigger_type,
  'req_' || k || '_' || n AS trigger_ref, happened AS occurred_at
FROM (
  SELECT k, id AS pid, 1 AS n, CAST(NULL AS VARCHAR) AS f, 'CREATED' AS t, created_at AS happened, 'API' AS trig FROM payments WHERE k % 107 <> 11
  UNION ALL SELECT k, id, 2, 'CREATED', 'FAILED', created_at + INTERVAL 2 HOUR, 'WEBHOOK' FROM payments WHERE k % 20 = 0
  UNION ALL SELECT k, id, 2, 'CREATED', 'AUTHORIZED', created_at, 'API' FROM payments WHERE k % 20 >= 2 AND k % 101 <> 7
  UNION ALL SELECT k, id, 3, CASE WHEN k % 103 = 9 THEN 'CREATED' ELSE 'AUTHORIZED' END, 'CAPTURED', captured_at, 'WEBHOOK' FROM payments WHERE k % 20 >= 3
  UNION ALL SELECT k, id, 4, 'CAPTURED', 'SETTLED', settled_at, 'SETTLEMENT' FROM payments WHERE settled_at IS NOT NULL
  UNION ALL SELECT k, id, 5, 'CAPTURED', 'REFUNDED', captured_at + INTERVAL 1 DAY, 'API' FROM payments WHERE k % 20 = 3
  UNION ALL SELECT k, id, 5, 'SETTLED', 'REFUNDED', captured_at + INTERVAL 40 DAY, 'API' FROM payments WHERE k % 20 = 4)"""

CTE["transitions"] = """
SELECT * FROM (VALUES ('CREATED','AUTHORIZED'), ('CREATED','FAILED'), ('AUTHORIZED','CAPTURED'), ('AUTHORIZED','FAILED'),
  ('CAPTURED','SETTLED'), ('CAPTURED','REFUNDED'), ('SETTLED','REFUNDED')) t(f, t)"""

CTE["ranks"] = """
SELECT * FROM (VALUES ('CREATED',1), ('AUTHORIZED',2), ('CAPTURED',3), ('SETTLED',4), ('FAILED',5), ('REFUNDED',6)) t(state, rank)"""

CTE["outcomes"] = """
SELECT * FROM (VALUES ('MATCHED',false,'LOW'), ('MATCHED_NOT_SETTLED',false,'LOW'), ('AMOUNT_MISMATCH',true,'HIGH'),
  ('CURRENCY_MISMATCH',true,'HIGH'), ('STATUS_MISMATCH',true,'HIGH'), ('REFERENCE_MISMATCH',true,'MEDIUM'),
  ('SETTLEMENT_DATE_MISMATCH',true,'LOW'), ('MISSING_ON_PROVIDER',true,'MEDIUM'), ('MISSING_INTERNAL',true,'MEDIUM'),
  ('DUPLICATE_PROVIDER_RECORD',true,'HIGH'), ('AMBIGUOUS_MATCH',true,'MEDIUM'), ('SETTLEMENT_RECORD_INVALID',true,'HIGH')
) t(outcome, requires_case, severity)"""

# ---------------------------------------------------------------- deliveries and events

CTE["raw_deliveries"] = """
SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS m, (CAST(floor(value * 100 + 0.5) AS BIGINT) * 300 + 5000) // 10000 AS fee,
  CASE user_id % 4 WHEN 0 THEN 'EGP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS ccy,
  'psp_e' || (user_id * 20 + e % 20) AS x1, 'psp_e' || (user_id * 20 + (e + 3) % 20) AS x2,
  CASE WHEN e % 59 = 0 THEN 'payment.disputed' WHEN e % 7 = 0 THEN 'settlement.paid' WHEN e % 11 = 0 THEN 'payment.refunded'
    WHEN event_type = 'signup' THEN 'payment.created' WHEN event_type = 'view' THEN 'payment.authorized'
    WHEN event_type = 'error' THEN 'payment.failed' ELSE 'payment.captured' END AS type,
  date_trunc('second', ts) + to_hours((e * 7919 + n * 13) % 480) AS received_at,
  CASE WHEN e % 37 = 0 THEN 600 WHEN e % 38 = 0 THEN 300 ELSE (e * 7919 + n) % 120 END AS age
FROM (SELECT event_id AS e, ts, user_id, event_type, value FROM events) x JOIN (VALUES (1), (2), (3)) c(n)
  ON n = 1 OR (n = 2 AND e % 10 = 0) OR (n = 3 AND e % 100 = 0)"""

CTE["bodied_deliveries"] = """
SELECT *, CASE WHEN e % 53 <> 0 THEN 'evt_' || e END AS event_id,
  CAST(CAST(epoch(received_at) AS BIGINT) - age AS VARCHAR) AS header_ts,
  CASE WHEN e % 47 = 0 THEN '{"type":' ELSE '{"type":"' || type || '","occurredAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"' ||
    CASE WHEN type = 'settlement.paid' THEN ',"settlement":{"providerSettlementId":"setl_' || e || '","settlementDate":"' || strftime(ts, '%Y-%m-%d')
      || '","currency":"' || ccy || '","grossAmountMinor":' || (2 * m + 100 + CASE WHEN e % 5 = 0 THEN 50 ELSE 0 END) || ',"feeAmountMinor":' || (2 * fee)
      || ',"netAmountMinor":' || (2 * (m - fee) + 100) || ',"lines":[{"providerTransactionId":"' || x1 || '","grossAmountMinor":' || m || ',"netAmountMinor":' || (m - fee)
      || '},{"providerTransactionId":"' || x2 || '","grossAmountMinor":' || (m + 100) || ',"netAmountMinor":' || (m - fee + 100) || '}]}'
    ELSE CASE WHEN e % 71 = 0 THEN '' ELSE ',"providerTransactionId":"' || x1 || '"' END
      || CASE WHEN e % 9 = 0 THEN '' ELSE ',"merchantReference":"MERCH-' || user_id || '"' END
      || CASE WHEN e % 13 = 0 THEN '' ELSE ',"gross":{"amountMinor":' || m || ',"currency":"' || ccy || '"}'
        || CASE WHEN e % 6 = 0 THEN '' ELSE ',"fee":{"amountMinor":' || fee || ',"currency":"' || ccy || '"}' END
        || ',"net":{"amountMinor":' || (m - fee) || ',"currency":"' || ccy || '"}' END
      || CASE type WHEN 'payment.authorized' THEN ',"status":"AUTHORIZED"' WHEN 'payment.captured' THEN ',"status":"CAPTURED"'
        WHEN 'payment.refunded' THEN ',"status":"REFUNDED"' WHEN 'payment.failed' THEN ',"status":"FAILED"' ELSE '' END
    END || '}' END AS body
FROM raw_deliveries"""

CTE["deliveries"] = f"""
SELECT 'del_' || e || '_' || n AS id, 'SIMULATED_PSP' AS provider, event_id, body, header_ts AS "timestamp",
  CASE WHEN e % 43 = 0 THEN '00ff' ELSE upper(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(header_ts || '.' || event_id || '.' || body))))) END AS signature,
  received_at, CASE WHEN e % 61 = 0 THEN 300000 ELSE strlen(body) END AS body_bytes, 'req_' || e || '_' || n AS request_id
FROM bodied_deliveries"""

CTE["checked_deliveries"] = f"""
SELECT *, CASE WHEN body_bytes > 262144 THEN 'TOO_LARGE'
    WHEN event_id IS NULL OR signature IS NULL THEN 'REJECTED_MALFORMED'
    WHEN abs(CAST(epoch(received_at) AS BIGINT) - CAST("timestamp" AS BIGINT)) > 300 THEN 'REJECTED_TIMESTAMP'
    WHEN lower(signature) <> sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode("timestamp" || '.' || event_id || '.' || body)))) THEN 'REJECTED_SIGNATURE'
    WHEN NOT json_valid(body) THEN 'REJECTED_MALFORMED' END AS rejection
FROM deliveries"""

CTE["classified_deliveries"] = """
SELECT *, CASE WHEN rejection IS NOT NULL THEN rejection
    WHEN row_number() OVER (PARTITION BY provider, event_id, rejection IS NULL ORDER BY received_at, id) = 1 THEN 'ACCEPTED' ELSE 'DUPLICATE' END AS outcome
FROM checked_deliveries"""

CTE["provider_events"] = """
SELECT provider, event_id, id AS delivery_id, received_at, body, request_id, json_extract_string(body, '$.type') AS event_type,
  strptime(json_extract_string(body, '$.occurredAt'), '%Y-%m-%dT%H:%M:%SZ') AS occurred_at,
  json_extract_string(body, '$.providerTransactionId') AS provider_transaction_id
FROM classified_deliveries WHERE outcome = 'ACCEPTED'"""

CTE["event_payments"] = """
SELECT DISTINCT 'pay_e' || x AS id, 'SIMULATED_PSP' AS provider, 'psp_e' || x AS provider_transaction_id, 'CREATED' AS state, ccy AS currency
FROM (SELECT user_id * 20 + event_id % 20 AS x, CASE user_id % 4 WHEN 0 THEN 'EGP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS ccy FROM events)
WHERE x % 13 <> 0"""

CTE["command_log"] = f"""
SELECT 'cmd_' || event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'POST /payments' ELSE 'POST /payouts' END AS endpoint,
  'key_' || user_id || '_' || (event_id % 5) AS idem_key, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'PUT' END AS method,
  '/v1/resource/' || (event_id % 2) AS path_template, '{{"amount":' || (event_id % 4) || '}}' AS body,
  'fp_' || (event_id % 4) AS fingerprint, ts, event_id % 4 <> 1 AS completed, ts + INTERVAL {RETENTION_DAYS} DAY AS expires_at
FROM events"""

_NAMES = re.compile(r"\b[a-z_0-9]+\b")


def sql(body: str) -> str:
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(_NAMES.findall(text))):
            if name in CTE and name not in ordered:
                visit(CTE[name])
                ordered.append(name)

    visit(body)
    parts = [f"{name} AS ({CTE[name].strip()})" for name in ordered]
    if "RECURSIVE " in body:
        # The body brings its own recursive expression after the shared ones.
        return "WITH RECURSIVE " + ",\n".join([*parts, body.strip().removeprefix("RECURSIVE ")])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
