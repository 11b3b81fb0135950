"""Deliveries, commands and the event fold against step-by-step Python."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from settlespark.session import written
from settlespark.operators import ingest, payments as pay
from settlespark.vocab import ALLOWED_TRANSITIONS, PAYMENT_STATES

T0 = dt.datetime(2024, 1, 1)
ALLOWED = set(ALLOWED_TRANSITIONS)
RANK = {s: i for i, s in enumerate(PAYMENT_STATES)}


def replay(events, state="CREATED"):
    """Apply events one at a time, keeping illegal ones waiting and trying them again after each change."""
    waiting, effects, met = [], {}, {}

    def attempt(target, current):
        if (current, target) in ALLOWED:
            return ("DEAD", current) if target == "SETTLED" else ("PROCESSED", target)
        if RANK[current] >= RANK[target]:
            return "NO_EFFECT", current
        if target == "SETTLED":
            return "DEAD", current
        if (current, target) == ("CREATED", "CAPTURED"):
            return "PROCESSED", target
        return "RETRY", current

    for eid, target in events:
        met[eid] = state
        effect, after = attempt(target, state)
        if effect == "RETRY":
            waiting.append((eid, target))
            continue
        effects[eid] = effect
        while after != state:
            state, again, waiting = after, waiting, []
            for wid, wtarget in again:
                effect, moved = attempt(wtarget, after)
                if effect == "RETRY":
                    waiting.append((wid, wtarget))
                else:
                    effects[wid] = effect
                    after = moved
    effects.update({wid: "FAILED" for wid, _ in waiting})
    return effects, state, met


def test_fold_matches_replay_for_every_order(spark):
    kinds = ["CREATED", "AUTHORIZED", "CAPTURED", "REFUNDED", "FAILED", "SETTLED"]
    orders = [p for n in range(1, 6) for p in itertools.permutations(kinds, n)]
    rng = random.Random(3)
    orders += [tuple(rng.choice(kinds) for _ in range(rng.randrange(2, 12))) for _ in range(600)]
    rows, pays, expected = [], [], {}
    for n, order in enumerate(orders):
        start = PAYMENT_STATES[n % 6]
        pays.append((f"p{n}", start))
        named = [(f"e{n}_{i}", t) for i, t in enumerate(order)]
        effects, final, met = replay(named, start)
        for i, (eid, target) in enumerate(named):
            # Equal times: the delivery id breaks the tie.
            rows.append((eid, f"p{n}", target, T0 + dt.timedelta(hours=i // 2), f"d{i:03d}"))
            expected[eid] = (effects[eid], final, met[eid])
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "event_id string, payment_id string, target_state string, received_at timestamp_ntz, delivery_id string")
    got = pay.fold_payment_events(events, spark.createDataFrame(pays, "id string, state string")).collect()
    assert {r.event_id: (r.final_effect, r.final_state, r.state_met) for r in got} == expected


def test_decision_matrix(spark):
    got = {(r.current_state, r.target_state): (r.decision, r.effect) for r in pay.event_decision(spark).collect()}
    assert len(got) == 36
    assert got["CREATED", "CAPTURED"] == ("APPLY_OUT_OF_ORDER", "PROCESSED")
    assert got["CAPTURED", "SETTLED"] == ("APPLY", "DEAD")
    assert got["SETTLED", "REFUNDED"] == ("APPLY", "PROCESSED")
    assert got["FAILED", "REFUNDED"] == ("APPLY_OUT_OF_ORDER", "RETRY")
    assert got["REFUNDED", "FAILED"] == ("NO_EFFECT", "NO_EFFECT")
    assert sum(r.allowed for r in pay.transition_matrix(spark).collect()) == 7


def test_commands_match_a_plain_loop(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}"
        ts = T0 + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 6))
        rows.append((f"c{i:05d}", "POST /x", key, f"f{rng.randrange(2)}", ts, rng.random() < 0.7, ts + dt.timedelta(days=1)))
    expected, owner = {}, {}
    for cid, _, key, fp, ts, done, expires in sorted(rows, key=lambda r: (r[2], r[4], r[0])):
        held = owner.get(key)
        if held is None or held[2] <= ts:
            expected[cid] = "FRESH" if held is None else "EXPIRED_TAKEOVER"
            owner[key] = (fp, done, expires)
        else:
            expected[cid] = "CONFLICT" if fp != held[0] else "REPLAY" if held[1] else "IN_PROGRESS"
    log = spark.createDataFrame(rows, "id string, endpoint string, idem_key string, fingerprint string, ts timestamp_ntz, completed boolean, expires_at timestamp_ntz")
    assert {r.id: r.decision for r in ingest.classify_commands(log).collect()} == expected


def test_many_takeovers_take_few_rounds(spark, monkeypatch):
    """500 takeovers of one key, 130 of another, records that expire at once or never."""
    rows = [(f"a{i:04d}", "POST /x", "long", "f", T0 + dt.timedelta(hours=i), True, T0 + dt.timedelta(hours=i + 1)) for i in range(501)]
    rows += [(f"b{i:04d}", "POST /x", "half", f"f{i % 2}", T0 + dt.timedelta(hours=i), i % 3 > 0, T0 + dt.timedelta(hours=i + 2)) for i in range(262)]
    rows += [("c0", "POST /x", "odd", "f", T0, True, T0), ("c1", "POST /x", "odd", "f", T0, True, T0 - dt.timedelta(hours=1)), ("c2", "POST /x", "odd", "f", T0, True, None),
             ("c3", "POST /x", "odd", "f", T0 + dt.timedelta(days=900), True, T0)]
    stored = []
    monkeypatch.setattr(ingest, "written", lambda df, label: stored.append(label) or written(df, label))
    log = spark.createDataFrame(rows, "id string, endpoint string, idem_key string, fingerprint string, ts timestamp_ntz, completed boolean, expires_at timestamp_ntz")
    got = {r.id: (r.owner_id, r.decision) for r in ingest.classify_commands(log).collect()}
    assert all(got[f"a{i:04d}"] == (f"a{i:04d}", "EXPIRED_TAKEOVER" if i else "FRESH") for i in range(501))
    assert all(got[f"b{i:04d}"][0] == f"b{i - i % 2:04d}" for i in range(262))
    assert {k: got[k] for k in ("c0", "c1", "c2", "c3")} == {
        "c0": ("c0", "FRESH"), "c1": ("c1", "EXPIRED_TAKEOVER"), "c2": ("c2", "EXPIRED_TAKEOVER"), "c3": ("c2", "REPLAY")}
    assert stored.count("command-chain") <= 11 and len(stored) <= 13


def test_takeover_and_purge_differ_at_the_instant(spark):
    log = spark.createDataFrame(
        [("a", "e", "k", "f", T0, True, T0 + dt.timedelta(days=1)), ("b", "e", "k", "g", T0 + dt.timedelta(days=1), True, T0 + dt.timedelta(days=2))],
        "id string, endpoint string, idem_key string, fingerprint string, ts timestamp_ntz, completed boolean, expires_at timestamp_ntz")
    assert {r.id: r.decision for r in ingest.classify_commands(log).collect()} == {"a": "FRESH", "b": "EXPIRED_TAKEOVER"}
    assert sorted(r.id for r in ingest.purge_expired_commands(log, "2024-01-02 00:00:00").collect()) == ["a", "b"]


def test_body_problems(spark):
    bodies = {
        "good": '{"type":"payment.captured","occurredAt":"2024-01-01T00:00:00Z"}', "cut": '{"type":', "extra": '{"type":"x","occurredAt":"2024-01-01T00:00:00Z","debug":1}',
        "untyped": '{"occurredAt":"2024-01-01T00:00:00Z"}', "timeless": '{"type":"x"}', "odd": '{"type":"x","occurredAt":"yesterday"}'}
    df = spark.createDataFrame(list(bodies.items()), "id string, body string")
    got = {r.id: r.reject_reason for r in ingest.parse_provider_events(df).collect()}
    assert got == {"good": None, "cut": "NOT_JSON", "extra": "UNKNOWN_FIELD", "untyped": "MISSING_TYPE", "timeless": "MISSING_OCCURRED_AT", "odd": "BAD_OCCURRED_AT"}


def test_times_keep_offset_and_fraction(spark):
    bodies = {"offset": "2024-01-01T10:00:00+02:00", "fraction": "2024-01-01T10:00:00.750Z", "plain": "2024-01-01T10:00:00Z"}
    df = spark.createDataFrame([(k, '{"type":"x","occurredAt":"%s"}' % v) for k, v in bodies.items()], "id string, body string")
    got = {r.id: r.occurred_at for r in ingest.parse_provider_events(df).collect()}
    assert got == {"offset": dt.datetime(2024, 1, 1, 8), "fraction": dt.datetime(2024, 1, 1, 10, 0, 0, 750_000), "plain": dt.datetime(2024, 1, 1, 10)}


def test_unknown_fields_are_refused_at_every_level(spark):
    line = '{"providerTransactionId":"t","grossAmountMinor":1,"netAmountMinor":1%s}'
    bodies = {
        "money": '"gross":{"amountMinor":1,"currency":"EGP","extra":1}', "settlement": '"settlement":{"providerSettlementId":"s","extra":1,"lines":[]}',
        "line": '"settlement":{"providerSettlementId":"s","lines":[%s,%s]}' % (line % "", line % ',"extra":1'), "fine": '"settlement":{"providerSettlementId":"s","lines":[%s]}' % (line % "")}
    df = spark.createDataFrame([(k, '{"type":"x","occurredAt":"2024-01-01T10:00:00Z",%s}' % v) for k, v in bodies.items()], "id string, body string")
    got = {r.id: r.reject_reason for r in ingest.parse_provider_events(df).collect()}
    assert got == {"money": "UNKNOWN_FIELD", "settlement": "UNKNOWN_FIELD", "line": "UNKNOWN_FIELD", "fine": None}


def test_a_settlement_without_lines_keeps_its_header(spark):
    report = '[{"providerSettlementId":"s1","currency":"EGP","lines":[]},{"providerSettlementId":"s2","currency":"EGP","lines":[{"providerTransactionId":"a"},{"providerTransactionId":"b"}]}]'
    df = spark.createDataFrame([("P", report)], "provider string, report string")
    assert sorted(r.provider_settlement_id for r in ingest.settlement_headers(df).collect()) == ["s1", "s2"]


def test_freshness_boundary(spark):
    epoch = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    rows = [("edge", str(epoch - 300)), ("late", str(epoch - 301)), ("ahead", f" {epoch + 300} "), ("odd", "soon"), ("none", None)]
    df = spark.createDataFrame(rows, "id string, timestamp string").withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert sorted(r.id for r in ingest.filter_event_freshness(df).collect()) == ["ahead", "edge"]


def test_outcome_precedence(spark):
    base = dict(provider="P", event_id="e", body='{"type":"x","occurredAt":"2024-01-01T00:00:00Z"}', body_bytes=10)
    epoch = str(int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()))
    cols = "id string, provider string, event_id string, body string, timestamp string, signature string, body_bytes int"
    rows = [
        ("a1", "P", "e", base["body"], epoch, "ok", 10), ("a2", "P", "e", base["body"], epoch, "ok", 10),
        ("big", "P", None, base["body"], "soon", "bad", 262145), ("limit", "P", "l", base["body"], epoch, "ok", 262144),
        ("noid", "P", " ", base["body"], epoch, "ok", 10), ("nosig", "P", "n", base["body"], "soon", None, 10),
        ("stale", "P", "s", base["body"], "1", "bad", 10), ("forged", "P", "f", "{", epoch, "bad", 10), ("junk", "P", "j", "{", epoch, "ok", 10)]
    df = spark.createDataFrame(rows, cols).withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("request_id", F.col("id"))
    df = df.withColumn("signature", F.when(F.col("signature") == "ok", F.concat(F.lit(" "), F.upper(ingest.expected_signature("s")))).otherwise(F.col("signature")))
    got = {r.id: (r.outcome, r.http_status) for r in ingest.classify_deliveries(df, "s").collect()}
    assert got == {
        "a1": ("ACCEPTED", 202), "a2": ("DUPLICATE", 200), "big": ("TOO_LARGE", 413), "limit": ("ACCEPTED", 202), "noid": ("REJECTED_MALFORMED", 400),
        "nosig": ("REJECTED_MALFORMED", 400), "stale": ("REJECTED_TIMESTAMP", 401), "forged": ("REJECTED_SIGNATURE", 401), "junk": ("REJECTED_MALFORMED", 400)}
