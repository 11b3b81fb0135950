"""Streams cut into several micro-batches in a shuffled order give what one batch gives."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from given import SF
from settlespark.operators import ingest, payments as pay
from settlespark.plans import events
from settlespark.session import new_path
from settlespark.sources.scenario import WEBHOOK_SECRET as SECRET
from settlespark.streaming import jobs
from settlespark.streaming.tables import EpochTable


@pytest.fixture(scope="module")
def pieces(spark):
    """The event table in four files; rows are dealt by a hash, so every file holds early and late ones."""
    path = new_path(spark, "pieces")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4, "event_id").write.parquet(path)
    return path


def stream(spark, path):
    return jobs.delivery_stream(jobs.streaming_session(spark), path, files_per_batch=1)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_first_copies_in_any_order_of_arrival(spark, scenario, pieces):
    """Copies come in shuffled micro-batches; the first by time of receipt is the same as in the batch."""
    got = jobs.run_dedupe_events(stream(spark, pieces), SECRET)
    columns = ("event_id", "delivery_id", "received_at", "body")
    assert rows(got, *columns) == rows(ingest.dedupe_provider_events(events.classified(scenario)), *columns)


def test_outcomes_in_any_order_of_arrival(spark, scenario, pieces):
    got = jobs.run_classify_deliveries(stream(spark, pieces), SECRET)
    columns = ("id", "outcome", "http_status", "signature_valid")
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert key(got) == key(ingest.classify_deliveries(scenario.deliveries, SECRET))


def signed(spark, rows, path):
    """Deliveries (micro-batch, id, event id, body, received_at) as one file per micro-batch."""
    every = spark.createDataFrame(rows, "batch int, id string, event_id string, body string, received_at timestamp_ntz")
    every = every.withColumn("provider", F.lit("P")).withColumn("body_bytes", F.octet_length("body")).withColumn(
        "timestamp", F.expr("cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', received_at) as string)"))
    every = every.withColumn("signature", ingest.expected_signature(SECRET))
    for batch in sorted({r[0] for r in rows}):
        every.filter(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return jobs.read_stream(jobs.streaming_session(spark), path, 1)


def test_late_and_repeated_copies_are_told_apart_by_the_stored_events(spark):
    body = lambda day: '{"type":"payment.captured","occurredAt":"2024-01-%02dT00:00:00Z","providerTransactionId":"t"}' % day
    at = lambda d: dt.datetime(2024, 2, d)
    rows_ = [(0, "a2", "a", body(1), at(2)), (0, "b1", "b", body(2), at(2)), (1, "c1", "c", body(20), at(21)), (2, "a1", "a", body(1), at(1)),
             (2, "b2", "b", body(2), at(9)), (3, "a3", "a", body(1), at(20)), (3, "d1", "d", body(1), at(20)), (3, "d0", "d", body(1), at(19))]
    target = new_path(spark, "copies")
    attempts, firsts = jobs.run_copies(signed(spark, rows_, new_path(spark, "copies-in")), SECRET, target, every=2)
    assert {(r.event_id, r.id) for r in firsts.collect()} == {("a", "a1"), ("b", "b1"), ("c", "c1"), ("d", "d0")}
    assert attempts.count() == len(rows_)


LIFECYCLE = {"created": "payment.created", "authorized": "payment.authorized", "captured": "payment.captured", "refunded": "payment.refunded"}


def _event(name, txn, sid):
    time = '"occurredAt":"2024-01-01T00:00:00Z"'
    if name == "settled":
        line = '{"providerTransactionId":"%s","grossAmountMinor":1000,"netAmountMinor":970}' % txn
        return ('{"type":"settlement.paid",%s,"settlement":{"providerSettlementId":"%s","settlementDate":"2024-01-03","currency":"EGP",'
                '"grossAmountMinor":1000,"feeAmountMinor":30,"netAmountMinor":970,"lines":[%s]}}') % (time, sid, line)
    return '{"type":"%s",%s,"providerTransactionId":"%s"}' % (LIFECYCLE[name], time, txn)


PAYMENT = "id string, provider string, provider_transaction_id string, state string, currency string"


def test_every_order_of_a_lifecycle_cut_into_micro_batches(spark):
    """24 orders of a settled payment, 6 of one told by events only, 6 of a refund racing its settlement: one micro-batch per step."""
    rows_, expected = [], {}
    for kinds, state in ((("created", "authorized", "captured", "settled"), "SETTLED"), (("authorized", "captured", "settled"), "SETTLED"),
                         (("captured", "settled", "refunded"), "REFUNDED")):
        for n, order in enumerate(itertools.permutations(kinds)):
            txn = f"{state}-{len(kinds)}-{n}"
            expected[txn] = state
            for step, name in enumerate(order):
                e = f"{txn}-{name}"
                rows_.append((step, f"d-{e}", e, _event(name, txn, f"s-{txn}"), dt.datetime(2024, 1, 1 + step)))
                rows_.append(((step + 2) % 4, f"x-{e}", e, _event(name, txn, f"s-{txn}"), dt.datetime(2024, 1, 9)))  # a copy, later or earlier
    assert len(expected) == 36
    known = spark.createDataFrame([(t, "P", t, "CREATED", "EGP") for t in expected], PAYMENT)
    states, settlements = jobs.run_payment_state(signed(spark, rows_, new_path(spark, "orders")), SECRET, known, every=2)
    assert {r.provider_transaction_id: r.state for r in states.collect()} == expected
    assert {(r.status, r.validity) for r in settlements.collect()} == {("PROCESSED", "VALID")} and settlements.count() == 36


def _half_settled(spark, last_step):
    """A settlement of two payments of which the second is captured late, in micro-batch ``last_step``."""
    line = lambda t: '{"providerTransactionId":"%s","grossAmountMinor":1000,"netAmountMinor":970}' % t
    both = ('{"type":"settlement.paid","occurredAt":"2024-01-01T00:00:00Z","settlement":{"providerSettlementId":"s","settlementDate":"2024-01-03","currency":"EGP",'
            '"grossAmountMinor":2000,"feeAmountMinor":60,"netAmountMinor":1940,"lines":[%s,%s]}}') % (line("t1"), line("t2"))
    rows_ = [(0, "d0", "e0", both, dt.datetime(2024, 1, 1)), (0, "d1", "e1", _event("captured", "t1", ""), dt.datetime(2024, 1, 1))]
    rows_ += [(k, f"f{k}", f"g{k}", _event("created", f"other{k}", ""), dt.datetime(2024, 1, 1 + k)) for k in range(1, last_step)]
    rows_ += [(last_step, "d2", "e2", _event("captured", "t2", ""), dt.datetime(2024, 1, 2))]
    known = spark.createDataFrame([(t, "P", t, "CREATED", "EGP") for t in ("t1", "t2")], PAYMENT)
    return rows_, known


def test_a_waiting_settlement_is_counted_and_dies(spark):
    rows_, known = _half_settled(spark, 4)
    for most, status, count, state in ((100, "PROCESSED", 0, "SETTLED"), (4, "DEAD", 4, "CAPTURED")):
        states, settlements = jobs.run_payment_state(signed(spark, rows_, new_path(spark, "waits")), SECRET, known, max_deferrals=most)
        assert {r.provider_transaction_id: r.state for r in states.collect()} == {"t1": state, "t2": state}
        assert [(r.status, r.deferrals) for r in settlements.collect()] == [(status, count)]
    before = [r for r in rows_ if r[0] < 4]
    states, settlements = jobs.run_payment_state(signed(spark, before, new_path(spark, "waits")), SECRET, known)
    assert [(r.status, r.deferrals) for r in settlements.collect()] == [("WAITING", 4)]
    assert {r.state for r in states.collect()} == {"CAPTURED"}


def test_pieces_are_merged_behind_the_stream(spark):
    """The number of pieces stays small over many epochs, a replayed epoch changes nothing, readers never see a row twice."""
    table = EpochTable(spark, new_path(spark, "merged"), lambda rows: jobs._newest(rows, ["k"]), every=3)
    most = 0
    for epoch in range(30):
        table.compact(epoch)
        for _ in range(2 if epoch % 7 == 0 else 1):  # now and then a batch is replayed
            table.write(spark.createDataFrame([(epoch % 5, epoch, epoch), (100 + epoch, epoch, epoch)], "k long, v long, epoch int").coalesce(1), epoch)
        most = max(most, len(table.pieces()))
    assert most <= 3 * 4
    found = jobs.last_epoch(table.read(table.schema()), ["k"]).collect()
    assert {r.k: r.v for r in found} == {k: 25 + k for k in range(5)} | {100 + e: e for e in range(30)}
    assert {p for p in table.pieces()} and len(table._complete()) <= most + 3 * 4


def test_provider_status(spark, scenario, pieces):
    batch = pay.provider_status_upsert(ingest.map_event_target_state(events.provider_events(scenario)).filter("routing = 'PAYMENT'"))
    columns = ("provider_transaction_id", "provider_status")
    assert rows(jobs.run_provider_status(stream(spark, pieces), SECRET, every=2), *columns) == rows(batch, *columns)
    whole = jobs.delivery_stream(jobs.streaming_session(spark), f"{SF}/events*.parquet")
    columns = ("provider_transaction_id", "provider_status", "gross_minor", "fee_minor", "net_minor", "currency", "captured_at")
    assert rows(jobs.run_provider_status(whole, SECRET), *columns) == rows(batch, *columns)


def test_payment_state(spark, scenario, pieces):
    whole = jobs.delivery_stream(jobs.streaming_session(spark), f"{SF}/events*.parquet")
    columns = ("provider_transaction_id", "state")
    known = scenario.event_payments
    cut = rows(jobs.run_payment_state(stream(spark, pieces), SECRET, known, every=2)[0], *columns)
    assert cut == rows(jobs.run_payment_state(whole, SECRET, known)[0], *columns)
    assert {s for _, s in cut} == {"CREATED", "AUTHORIZED", "CAPTURED", "SETTLED", "FAILED", "REFUNDED"}


MARK = "struct<received_at timestamp_ntz, delivery_id string>"


def test_a_settlement_takes_effect_only_as_a_whole(spark):
    at = lambda i: (dt.datetime(2024, 1, i), f"d{i}")
    marks = spark.createDataFrame([("P", "t1", at(1), None), ("P", "t2", None, None), ("P", "t3", at(2), None), ("P", "t4", at(5), at(4)), ("P", "t5", at(3), None)],
                                  f"provider string, provider_transaction_id string, c {MARK}, f {MARK}")
    line = lambda *names: [(n, 1, 1) for n in names]
    records = spark.createDataFrame(
        [("half", "VALID", line("t1", "t2")), ("ready", "VALID", line("t3", "stranger")), ("failed", "VALID", line("t3", "t4")), ("refused", "INVALID", line("t5"))],
        "id string, validity string, lines array<struct<providerTransactionId string, grossAmountMinor bigint, netAmountMinor bigint>>").selectExpr(
        "*", "'P' as provider", "timestamp_ntz'2024-02-01 00:00:00' as received_at", "id as delivery_id")
    payments = spark.createDataFrame([("P", f"t{i}") for i in range(1, 6)], "provider string, provider_transaction_id string")
    got = jobs.settled_marks(marks, records, payments).collect()
    assert [(r.provider_transaction_id, r.s.delivery_id) for r in got] == [("t3", "ready")]


def test_a_stopped_stream_goes_on_where_it_ended(spark, scenario, pieces):
    first, both, target = new_path(spark, "first"), new_path(spark, "both"), new_path(spark, "target")
    known = scenario.event_payments
    table = spark.read.parquet(pieces)
    for path in (first, both):
        table.filter("event_id % 2 = 0").write.parquet(path)
    table.filter("event_id % 2 = 1").write.mode("append").parquet(both)
    part = jobs.run_payment_state(stream(spark, first), SECRET, known, target)[0]
    assert part.count() > 0
    table.filter("event_id % 2 = 1").write.mode("append").parquet(first)  # more arrives
    resumed = jobs.run_payment_state(stream(spark, first), SECRET, known, target)[0]
    columns = ("provider_transaction_id", "state")
    assert rows(resumed, *columns) == rows(jobs.run_payment_state(stream(spark, both), SECRET, known)[0], *columns)
    again = jobs.run_payment_state(stream(spark, first), SECRET, known, target)[0]  # nothing new
    assert rows(again, *columns) == rows(resumed, *columns)


def test_settlements_are_inserted_once(spark, scenario, pieces):
    live = stream(spark, pieces)
    got = jobs.run_settlements(live, SECRET, scenario.event_payments)
    assert got.count() == got.select("id").distinct().count() > 0
    whole = jobs.run_settlements(jobs.delivery_stream(jobs.streaming_session(spark), f"{SF}/events*.parquet"), SECRET, scenario.event_payments)
    assert rows(got, "id", "validity", "rule") == rows(whole, "id", "validity", "rule")


def test_balances(spark, scenario):
    from settlespark.operators import ledger
    live = jobs.streaming_session(spark)
    path = new_path(spark, "entry-pieces")
    scenario.ledger_entries.repartition(3, "id").write.parquet(path)
    got = jobs.run_balances(jobs.read_stream(live, path, 1), scenario.accounts)
    batch = ledger._recomputed(scenario.ledger_entries, scenario.accounts)
    columns = ("account_id", "currency", "balance_minor", "entry_count")
    assert rows(got, *columns) == rows(batch, *columns)


def test_empty_stream_leaves_an_empty_table(spark, scenario, pieces):
    none = new_path(spark, "none")
    spark.read.parquet(pieces).limit(0).write.parquet(none)
    assert jobs.run_payment_state(stream(spark, none), SECRET, scenario.event_payments)[0].isEmpty()
