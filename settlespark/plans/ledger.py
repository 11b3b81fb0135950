"""Registered ledger reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from settlespark import vocab
from settlespark.operators import ledger as l
from settlespark.plans.derive_sql import CTE
from settlespark.plans.registry import query

CTE["currencies"] = "SELECT * FROM (VALUES ('EGP'), ('USD'), ('EUR'), ('GBP')) t(code)"
CTE["recomputed"] = """
SELECT e.account_id, e.currency, CAST(sum(CASE WHEN e.direction = a.normal_side THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS balance_minor,
  count(*) AS entry_count, max(posted_at) AS last_entry_at FROM ledger_entries e JOIN accounts a ON a.id = e.account_id GROUP BY e.account_id, e.currency"""
CTE["balances"] = """
SELECT a.id AS account_id, c.code AS currency, coalesce(r.balance_minor, 0) AS balance_minor, coalesce(r.entry_count, 0) AS entry_count, r.last_entry_at
FROM accounts a CROSS JOIN currencies c LEFT JOIN recomputed r ON r.account_id = a.id AND r.currency = c.code"""
CTE["stored_balances"] = """
SELECT account_id, currency, balance_minor + CASE WHEN account_id = 'acct_psp_clearing' AND currency = 'USD' THEN 1 ELSE 0 END AS balance_minor,
  entry_count - CASE WHEN account_id = 'acct_merchant_payable' AND currency = 'EUR' THEN 1 ELSE 0 END AS entry_count
FROM balances WHERE NOT (account_id = 'acct_platform_cash' AND currency = 'GBP')"""


def balances(s):
    return l.account_balances(s.ledger_entries, s.accounts, vocab.currency_units(s.spark))


def stored_balances(s):
    return balances(s).filter("not (account_id = 'acct_platform_cash' and currency = 'GBP')").withColumns({
        "balance_minor": F.expr("balance_minor + case when account_id = 'acct_psp_clearing' and currency = 'USD' then 1 else 0 end"),
        "entry_count": F.expr("entry_count - case when account_id = 'acct_merchant_payable' and currency = 'EUR' then 1 else 0 end")})


@query("seed_balances", """SELECT a.id AS account_id, c.currency, CAST(0 AS BIGINT) AS balance_minor, CAST(0 AS BIGINT) AS entry_count
FROM accounts a CROSS JOIN (SELECT DISTINCT currency FROM payments) c""")
def _(s):
    used = s.payments.select(F.col("currency").alias("code")).distinct().withColumn("active", F.lit(True))
    return l.seed_balances(s.accounts, used)


@query("account_balances", "SELECT * FROM balances")
def _(s):
    return balances(s)


@query("trial_balance", """SELECT currency, coalesce(account_type, 'ALL') AS account_type, CAST(sum(amount_minor) FILTER (direction = 'DEBIT') AS BIGINT) AS debits,
  CAST(sum(amount_minor) FILTER (direction = 'CREDIT') AS BIGINT) AS credits,
  CAST(coalesce(sum(amount_minor) FILTER (direction = 'DEBIT'), 0) - coalesce(sum(amount_minor) FILTER (direction = 'CREDIT'), 0) AS BIGINT) AS difference
FROM ledger_entries e JOIN accounts a ON a.id = e.account_id GROUP BY ROLLUP (currency, account_type) HAVING currency IS NOT NULL""")
def _(s):
    return l.trial_balance(s.ledger_entries, s.accounts)


CTE["compared"] = """
SELECT a.code AS account_code, coalesce(b.currency, r.currency) AS currency, coalesce(b.balance_minor, 0) AS projected_minor, coalesce(r.balance_minor, 0) AS recomputed_minor,
  coalesce(b.entry_count, 0) AS projected_count, coalesce(r.entry_count, 0) AS actual_count, b.account_id IS NULL AS no_projection
FROM stored_balances b FULL OUTER JOIN recomputed r ON r.account_id = b.account_id AND r.currency = b.currency JOIN accounts a ON a.id = coalesce(b.account_id, r.account_id)"""


@query("verify_balances", """SELECT account_code, currency, projected_minor, recomputed_minor, projected_count, actual_count, projected_minor - recomputed_minor AS delta_minor,
  projected_count = 0 AND actual_count > 0 AS missing_projection FROM compared WHERE projected_minor <> recomputed_minor OR projected_count <> actual_count OR no_projection""")
def _(s):
    return l.verify_balances(stored_balances(s), s.ledger_entries, s.accounts)


@query("account_view", """SELECT account_code, currency, projected_minor, recomputed_minor, actual_count, projected_minor = recomputed_minor AND projected_count = actual_count AS verified
FROM compared WHERE account_code = 'PSP_CLEARING' AND currency = 'USD'""")
def _(s):
    return l.account_view(stored_balances(s), s.ledger_entries, s.accounts, "PSP_CLEARING", "USD")


@query("account_statement_page", """SELECT id, transaction_id, direction, amount_minor, posted_at, (SELECT count(*) > 50 FROM page_51) AS has_more
FROM page_51 ORDER BY posted_at DESC, id DESC LIMIT 50""".replace("page_51", """(SELECT * FROM ledger_entries WHERE account_code = 'PLATFORM_CASH' AND currency = 'EGP'
  AND (posted_at < TIMESTAMP '2000-06-01 00:00:00' OR (posted_at = TIMESTAMP '2000-06-01 00:00:00' AND id < 'le_m')) ORDER BY posted_at DESC, id DESC LIMIT 51)"""))
def _(s):
    return l.account_statement_page(s.ledger_entries, "PLATFORM_CASH", "EGP", 50, ("2000-06-01 00:00:00", "le_m"))


@query("transaction_with_entries", """SELECT t.id, type, t.currency, source_type, source_id, t.posted_at,
  '[' || string_agg('{"line_no":' || line_no || ',"account_code":"' || account_code || '","direction":"' || direction || '","amount_minor":' || amount_minor || '}', ',' ORDER BY line_no) || ']' AS entries
FROM ledger_transactions t LEFT JOIN ledger_entries e ON e.transaction_id = t.id GROUP BY ALL""")
def _(s):
    return l.transaction_with_entries(s.ledger_transactions, s.ledger_entries)


@query("list_accounts", """SELECT a.*, count(e.id) AS entry_count FROM accounts a LEFT JOIN ledger_entries e ON e.account_id = a.id GROUP BY ALL ORDER BY a.code""")
def _(s):
    used = s.ledger_entries.groupBy(F.col("account_id").alias("id")).agg(F.count(F.lit(1)).alias("entry_count"))
    return l.list_accounts(s.accounts.join(used, "id", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)).cast("bigint")))


@query("payment_ledger_story", """SELECT l.payment_id, l.role, t.id AS transaction_id, t.type, t.posted_at, e.line_no, e.account_code, e.direction, e.amount_minor
FROM ledger_links l JOIN ledger_transactions t ON t.id = l.ledger_transaction_id JOIN ledger_entries e ON e.transaction_id = t.id""")
def _(s):
    return l.payment_ledger_story(s.ledger_links, s.ledger_transactions, s.ledger_entries)
