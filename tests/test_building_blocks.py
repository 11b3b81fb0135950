"""Ordered and keyed building blocks, money and keyed hashes against plain Python."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from settlespark.functions import ordered
from settlespark.functions.crypto import hmac_sha256
from settlespark.functions.keyed import first_per_key, mark_first
from settlespark.functions.once import once
from settlespark.operators import fees


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows, so its rows must span several slices; others hold one or a few."""
    rng = random.Random(7)
    rows = [(("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}"), rng.randrange(300), i, rng.randrange(-50, 50)) for i in range(4000)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    out, totals, counts, last = {}, {}, {}, {}
    for key, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        totals[key] = totals.get(key, 0) + v
        counts[key] = counts.get(key, 0) + 1
        out[i] = (totals[key], counts[key], last.get(key), key not in last)
        last[key] = v
    return out


def test_ordered_values_match_a_plain_loop(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, at int, i int, v int").repartition(6)
    expected = brute(skewed)
    sums = ordered.running_sums(df, ["key"], ["at", "i"], {"total": F.col("v")})
    assert {r.i: r.total for r in sums.collect()} == {i: e[0] for i, e in expected.items()}
    numbers = ordered.row_numbers(df, ["key"], ["at", "i"], "n")
    assert {r.i: r.n for r in numbers.collect()} == {i: e[1] for i, e in expected.items()}
    before = ordered.previous_values(df, ["key"], ["at", "i"], {"prev": "v"})
    assert {r.i: (r.prev, r.is_first) for r in before.collect()} == {i: e[2:] for i, e in expected.items()}


def test_hot_key_spans_slices(spark, skewed):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(skewed, "key string, at int, i int, v int")
        cut = ordered.sliced(df, ["key"], ["at", "i"], "test")
        assert cut.filter("key = 'hot'").select(ordered.SLICE).distinct().count() > 1
        expected = brute(skewed)
        sums = ordered.running_sums(df, ["key"], ["at", "i"], {"total": F.col("v")})
        assert {r.i: r.total for r in sums.collect()} == {i: e[0] for i, e in expected.items()}
        before = ordered.previous_values(df, ["key"], ["at", "i"], {"prev": "v"})
        assert {r.i: (r.prev, r.is_first) for r in before.collect()} == {i: e[2:] for i, e in expected.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbers_over_everything(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, at int, i int, v int")
    numbers = {r.i: r.n for r in ordered.row_numbers(df, [], ["at", "i"], "n").collect()}
    order = sorted(skewed, key=lambda r: (r[1], r[2]))
    assert numbers == {r[2]: n for n, r in enumerate(order, 1)}


def test_first_per_key(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, at int, i int, v int")
    firsts = {}
    for key, at, i, v in sorted(skewed, key=lambda r: (r[0], r[1], r[2])):
        firsts.setdefault(key, i)
    assert {r.key: r.i for r in first_per_key(df, ["key"], ["at", "i"]).collect()} == firsts
    marked = mark_first(df, ["key"], ["at", "i"], "i", "first").filter("first").collect()
    assert {r.key: r.i for r in marked} == firsts


def test_once_keeps_nulls(spark):
    df = spark.range(3).withColumn("x", F.expr("case when id <> 1 then id end"))
    assert sorted((r.id, r.y) for r in once(df, "y", F.col("x") + 1).collect()) == [(0, 1), (1, None), (2, 3)]


@pytest.mark.parametrize("secret", ["short", "x" * 64, "longer than one block " * 8])
def test_keyed_hash(spark, secret):
    texts = ["", "a", "évènement ✓", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hmac_sha256(secret, F.col("t")).alias("h")).collect()
    for r in rows:
        assert r.h == hmac.new(secret.encode(), r.t.encode(), hashlib.sha256).hexdigest()


def test_fee_rounds_half_up_and_splits_exactly(spark):
    cases = [(10000, 300), (1, 300), (16, 300), (17, 300), (50, 100), (49, 100), (150, 100), (0, 300), (10**12, 10000), (999, 0), (5000, 1)]
    rows = fees.fee_split(spark.createDataFrame(cases, "amount_minor bigint, bps int")).collect()
    for r in rows:
        exact = r.amount_minor * r.bps
        assert r.fee_minor == exact // 10000 + (1 if exact % 10000 >= 5000 else 0)
        assert r.fee_minor + r.net_minor == r.amount_minor


def test_money_text(spark):
    rows = spark.createDataFrame([("EGP", 10000), ("USD", 5), ("EUR", 0), ("GBP", -123456)], "currency string, amount_minor bigint")
    shown = {r.currency: r.display for r in fees.money_display(rows).collect()}
    assert shown == {"EGP": "EGP 100.00", "USD": "USD 0.05", "EUR": "EUR 0.00", "GBP": "GBP -1234.56"}


def test_fee_policy_falls_back_and_ignores_inactive(spark):
    pay = spark.createDataFrame([("1", "EGP"), ("2", "USD"), ("3", "GBP"), ("4", "EUR")], "id string, currency string")
    policies = spark.createDataFrame([("d", "DEFAULT", 300, "EGP", True), ("u", "USD_X", 250, "USD", True), ("g", "GBP_X", 200, "GBP", False)],
                                     "id string, code string, bps int, currency string, active boolean")
    chosen = {r.id: (r.fee_policy_id, r.bps) for r in fees.select_fee_policy(pay, policies).collect()}
    assert chosen == {"1": ("d", 300), "2": ("u", 250), "3": ("d", 300), "4": ("d", 300)}
    none = fees.select_fee_policy(pay, policies.filter("code <> 'DEFAULT'")).filter("id = '4'").first()
    assert none.fee_policy_id is None and none.fee_policy_code is None
