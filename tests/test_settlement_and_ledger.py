"""Settlement rules, the worked ledger cycle, payouts, cases and pages against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from settlespark import vocab
from settlespark.operators import cases, checks, ledger, payments as pay, payouts, postings, settlement

REC = "id string, provider string, provider_settlement_id string, gross_amount_minor bigint, fee_amount_minor bigint, net_amount_minor bigint, currency string, settlement_date date"
LINE = "settlement_record_id string, provider_transaction_id string, line_gross_minor bigint, line_net_minor bigint, line_no bigint"
DAY = dt.date(2024, 5, 1)
AT = dt.datetime(2024, 5, 1)

# name: (header gross, fee, net, currency, lines, rule, text found in the reason)
STATEMENTS = {
    "good": (300, 9, 291, "EGP", [("t1", 100, 97), ("t2", 200, 194)], "-", None),
    "unknown_txn": (50, 1, 49, "EGP", [("nobody", 50, 49)], "-", None),
    "lower": (100, 3, 97, " egp ", [("nobody2", 100, 97)], "-", None),
    "s1": (0, 0, 0, "EGP", [], "S1", "no lines"),
    "s2": (301, 9, 291, "EGP", [("t1", 100, 97), ("t2", 200, 194)], "S2-S4", "gross 301 against 2 lines with 300"),
    "s3": (300, 9, 290, "EGP", [("t1", 100, 97), ("t2", 200, 194)], "S2-S4", "net 290 against 291"),
    "s4": (300, 10, 291, "EGP", [("t1", 100, 97), ("t2", 200, 194)], "S2-S4", "fee 10 against 9 (gross 300 − net 291)"),
    "s234": (1, 2, 3, "EGP", [("t1", 100, 97)], "S2-S4", "with 100; net 3 against 97; fee 2"),
    "s5": (100, -1, 101, "EGP", [("t1", 100, 101)], "S7", "total below zero"),
    "s5_line": (300, 2, 298, "EGP", [("t2", 200, 197), ("t1", 100, 101), ("t3", 1, 2)], "S5", "line t1: net 101 above gross 100"),
    "s6": (200, 6, 194, "EGP", [("t1", 100, 97), ("t1", 100, 97)], "S6", "transaction t1 listed 2 times"),
    "s7": (-1, 0, 0, "EGP", [("t1", 100, 97)], "S7", "total below zero, gross -1, fee 0, net 0"),
    "s7_line": (100, 3, 97, "EGP", [("t1", 100, 97), ("t2", -5, -5)], "S7", "line t2: amount below zero, gross -5, net -5"),
    "s8": (100, 3, 97, "JPY", [("t1", 100, 97)], "S8", "unsupported currency JPY"),
    "s9": (100, 3, 97, "USD", [("t1", 100, 97)], "S9", "USD settlement, transaction t1 belongs to a EGP payment"),
    "s9_first": (100, 3, 97, "EGP", [("nobody", 1, 1), ("u1", 100, 97), ("u1", 1, 1)], "S9", "transaction u1 belongs to a USD payment"),
}


def test_statement_rules(spark):
    heads = [(n, "P", n, g, f, m, c, DAY) for n, (g, f, m, c, *_rest) in STATEMENTS.items()]
    lines = [(n, t, g, m, i) for n, s in STATEMENTS.items() for i, (t, g, m) in enumerate(s[4], 1)]
    pays = spark.createDataFrame([("p1", "P", "t1", "EGP"), ("p2", "P", "t2", "EGP"), ("p3", "P", "u1", "USD"), ("p4", "Q", "nobody", "USD")],
                                 "id string, provider string, provider_transaction_id string, currency string")
    got = {r.id: r for r in settlement.validate_settlements(spark.createDataFrame(heads, REC), spark.createDataFrame(lines, LINE), pays).collect()}
    for name, (*_, rule, text) in STATEMENTS.items():
        assert got[name].rule == rule, name
        assert got[name].validity == ("VALID" if rule == "-" else "INVALID")
        if text is None:
            assert got[name].validity_reason is None
        else:
            assert text in got[name].validity_reason, got[name].validity_reason


def test_long_reason_stays_whole(spark):
    name = "s" * 600
    got = settlement.validate_settlements(spark.createDataFrame([("r", "P", name, 0, 0, 0, "EGP", DAY)], REC), spark.createDataFrame([], LINE),
                                          spark.createDataFrame([], "id string, provider string, provider_transaction_id string, currency string")).first()
    assert got.validity_reason == f"settlement {name}: no lines"


def test_worked_cycle_leaves_the_fee(spark):
    pays = spark.createDataFrame([("p", 10000, 300, 9700, "EGP", "r", AT)],
                                 "id string, amount_minor bigint, platform_fee_minor bigint, net_amount_minor bigint, currency string, settlement_record_id string, captured_at timestamp_ntz")
    records = spark.createDataFrame([("r", "P", "r", 10000, 300, 9700, "EGP", DAY, "VALID")], REC + ", validity string")
    payout = spark.createDataFrame([("po", "M", "EGP", 9700, AT)], "id string, merchant_reference string, currency string, total_net_minor bigint, executed_at timestamp_ntz")
    made = postings.post_captures(pays).unionByName(postings.post_settlements(records, pays)).unionByName(postings.post_payouts(payout))
    entries, accounts = postings.entries(made), vocab.ledger_accounts(spark)
    balance = {(r.account_id, r.currency): r.balance_minor for r in ledger.account_balances(entries, accounts, vocab.currency_units(spark)).collect()}
    assert len(balance) == 20
    assert balance["acct_platform_cash", "EGP"] == balance["acct_platform_fee_rev", "EGP"] == 300
    assert balance["acct_psp_clearing", "EGP"] == balance["acct_merchant_payable", "EGP"] == 0
    total = [r for r in ledger.trial_balance(entries, accounts).collect() if r.account_type == "ALL"]
    assert [(r.currency, r.difference) for r in total] == [("EGP", 0)]
    assert postings.validate_posting_commands(postings.headers(made), entries).isEmpty()

    undone = postings.post_reversals(made, spark.createDataFrame([("ltx_cap_p", "again", AT), ("ltx_cap_p", "why", AT)], "transaction_id string, reason string, posted_at timestamp_ntz"))
    both = made.unionByName(undone)
    assert undone.count() == 1
    assert checks.ledger_reversal_not_mirror(postings.headers(both), postings.entries(both)).isEmpty()
    repeat = postings.post_reversals(made, undone.select("reversal_of_transaction_id", F.lit("x").alias("reason"), "posted_at").withColumnRenamed(
        "reversal_of_transaction_id", "transaction_id"), already=undone)
    assert repeat.isEmpty()


def test_zero_fee_leg_is_reported_not_dropped(spark):
    pays = spark.createDataFrame([("p", 100, 0, 100, "EGP", AT)],
                                 "id string, amount_minor bigint, platform_fee_minor bigint, net_amount_minor bigint, currency string, captured_at timestamp_ntz")
    made = postings.post_captures(pays)
    assert postings.entries(made).count() == 3
    assert [r.failed_rule for r in postings.validate_posting_commands(postings.headers(made), postings.entries(made)).collect()] == ["ZERO_ENTRY"]


def test_adjustment_takes_either_direction(spark):
    rows = spark.createDataFrame([("c1", "DEBIT", 5, "EGP", AT), ("c2", "CREDIT", 7, "EGP", AT)], "case_id string, direction string, amount_minor bigint, currency string, posted_at timestamp_ntz")
    legs = {(r.transaction_id, r.account_code): (r.direction, r.amount_minor) for r in postings.entries(postings.post_psp_adjustments(rows)).collect()}
    assert legs["ltx_adj_c1", "PSP_CLEARING"] == ("DEBIT", 5) and legs["ltx_adj_c1", "PLATFORM_CASH"] == ("CREDIT", 5)
    assert legs["ltx_adj_c2", "PSP_CLEARING"] == ("CREDIT", 7) and legs["ltx_adj_c2", "PLATFORM_CASH"] == ("DEBIT", 7)


def test_clean_ledger_breaks_nothing(scenario):
    h, e, a = scenario.ledger_transactions, scenario.ledger_entries, scenario.accounts
    for found in (checks.ledger_unbalanced(e), checks.ledger_currency_breaks(h, e), checks.ledger_shape_breaks(e), checks.ledger_empty_headers(h, e),
                  checks.ledger_account_code_breaks(e, a), checks.ledger_double_reversals(h), checks.ledger_reversal_shape_breaks(h),
                  checks.ledger_reversal_not_mirror(h, e), checks.ledger_double_postings(h), checks.asset_negative_balances(e, a)):
        assert found.isEmpty()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cash_goes_out_in_order(spark, seed):
    rng = random.Random(seed)
    cash = {"EGP": rng.randrange(10**6), "USD": 2**14, "EUR": 0, "GBP": -5}
    rows = []
    for i in range(400):
        ccy = rng.choice(["EGP", "EGP", "EGP", "USD", "EUR", "GBP", "JPY"])
        rows.append((f"po{i:04d}", "ACCEPTED" if rng.random() < 0.9 else "EMPTY", ccy, rng.choice([0, 1, rng.randrange(50), rng.randrange(5000), 2 ** rng.randrange(21)])))
    expected, left = {}, {c: max(v, 0) for c, v in cash.items()}
    for pid, verdict, ccy, ask in rows:
        if verdict != "ACCEPTED":
            continue
        fits = ask <= left.get(ccy, 0)
        expected[pid] = "EXECUTABLE" if fits else "INSUFFICIENT_CASH"
        if fits:
            left[ccy] = left.get(ccy, 0) - ask
    asked = spark.createDataFrame(rows, "payout_id string, verdict string, currency string, total_net_minor bigint").repartition(5)
    balances = spark.createDataFrame([("acct_platform_cash", c, v) for c, v in cash.items()], "account_id string, currency string, balance_minor bigint")
    assert {r.payout_id: r.verdict for r in payouts.payout_cash_check(asked, balances).collect()} == expected


def test_payout_mixed_currency(spark):
    req = spark.createDataFrame([("r", "M")], "payout_id string, merchant_reference string")
    lines = spark.createDataFrame([("r", "a"), ("r", "b")], "payout_id string, payment_id string")
    pays = spark.createDataFrame([("a", "SETTLED", "EGP", 5, "M"), ("b", "SETTLED", "USD", 5, "M")], "id string, state string, currency string, net_amount_minor bigint, merchant_reference string")
    none = spark.createDataFrame([], "payment_id string")
    assert payouts.payout_request_checks(req, lines, pays, none).first().verdict == "CURRENCY_MISMATCH"


def test_case_commands_match_a_plain_loop(spark):
    rng = random.Random(5)
    start = {f"c{i}": rng.choice(vocab.CASE_STATUSES) for i in range(60)}
    rows = []
    for c in [*start, "nobody"]:
        for seq in range(rng.randrange(1, 9)):
            rows.append((c, seq, rng.choice(["INVESTIGATE", "RESOLVE", "WRITE_OFF"]), rng.choice([None, " ", "me"]), rng.choice([None, "short", " " * 30, "a note that is long enough"]),
                         rng.choice([None, "SHRUG", "OTHER", "TIMING_DIFFERENCE"])))
    expected, status = {}, dict(start)
    for c, seq, command, owner, note, action in rows:
        now = status.get(c)
        if command == "INVESTIGATE":
            verdict = "OWNER_REQUIRED" if not (owner or "").strip() else "NO_SUCH_CASE" if now is None else "INVALID_TRANSITION" if now != "OPEN" else "ACCEPTED"
            after = "INVESTIGATING"
        else:
            verdict = ("NOTE_TOO_SHORT" if len((note or "").strip()) < 20 else "ACTION_REQUIRED" if command == "WRITE_OFF" and action not in vocab.WRITE_OFF_ACTIONS
                       else "NO_SUCH_CASE" if now is None else "ACCEPTED" if now in ("OPEN", "INVESTIGATING") else "INVALID_TRANSITION")
            after = "RESOLVED" if command == "RESOLVE" else "WRITTEN_OFF"
        if verdict == "ACCEPTED":
            status[c] = after
        expected[c, seq] = (verdict, now, after if verdict == "ACCEPTED" else now)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "case_id string, seq bigint, command string, assigned_to string, note string, action string")
    got = cases.apply_case_commands(spark.createDataFrame(list(start.items()), "id string, status string"), df).collect()
    assert {(r.case_id, r.seq): (r.verdict, r.status_before, r.status_after) for r in got} == expected


def test_pages_visit_each_row_once(spark):
    rows = [(f"e{i:03d}", "t", "DEBIT", 1, AT + dt.timedelta(hours=i // 7), "PSP_CLEARING", "EGP") for i in range(45)]
    entries = spark.createDataFrame(rows, "id string, transaction_id string, direction string, amount_minor bigint, posted_at timestamp_ntz, account_code string, currency string")
    seen, after = [], None
    while True:
        got = ledger.account_statement_page(entries, "PSP_CLEARING", "EGP", 10, after).collect()
        seen += [r.id for r in got]
        if not got[-1].has_more:
            break
        after = (str(got[-1].posted_at), got[-1].id)
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[4], r[0]), reverse=True)]


def test_page_limits(spark, scenario):
    with pytest.raises(ValueError):
        pay.payments_page(scenario.payments, limit=201)


def test_drift_includes_missing_projection(spark):
    entries = spark.createDataFrame([("acct_platform_cash", "EGP", "DEBIT", 5, AT), ("acct_psp_clearing", "EGP", "CREDIT", 5, AT)],
                                    "account_id string, currency string, direction string, amount_minor bigint, posted_at timestamp_ntz")
    stored = spark.createDataFrame([("acct_psp_clearing", "EGP", -5, 1), ("acct_psp_clearing", "USD", 0, 0)], "account_id string, currency string, balance_minor bigint, entry_count bigint")
    got = ledger.verify_balances(stored, entries, vocab.ledger_accounts(spark)).collect()
    assert [(r.account_code, r.delta_minor, r.missing_projection) for r in got] == [("PLATFORM_CASH", -5, True)]


def test_unique_keys_read_each_table_once(spark, tmp_path):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("a", None), ("b", "x"), ("b", "y")]
    spark.createDataFrame(rows, "p string, q string").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("a",), ("b",)] * 500, "p string").write.parquet(str(tmp_path / "u"))
    t, u = (spark.read.parquet(str(tmp_path / n)) for n in "tu")
    found = checks.unique_key_breaks([("t(p, q)", t, ["p", "q"]), ("t(q)", t, ["q"]), ("u(p)", u, ["p"])])
    assert sorted(map(tuple, found.collect())) == [
        ("t(p, q)", "a", 2), ("t(p, q)", "a|x", 2), ("t(q)", "", 2), ("t(q)", "x", 3), ("u(p)", "a", 500), ("u(p)", "b", 500)]
    plan = found._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].count("Relation [") == 2
    assert "Sort" not in plan.split("== Physical Plan ==")[1]
