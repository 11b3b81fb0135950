"""The fifty-subject batch, precedence, population windows and re-runs."""

import datetime as dt

from pyspark.sql import functions as F

from settlespark import vocab
from settlespark.operators import cases, matching as m, postings

P = "SIMULATED_PSP"
NOW = dt.datetime(2024, 5, 10, 12)
TODAY = NOW.date()
WINDOW = ("2024-05-01 00:00:00", "2024-06-01 00:00:00")
PAY = ("id string, merchant_reference string, amount_minor bigint, platform_fee_minor bigint, net_amount_minor bigint, currency string, state string, provider string, "
       "provider_transaction_id string, settlement_record_id string, captured_at timestamp_ntz")
PROV = ("id string, provider string, provider_transaction_id string, merchant_reference string, gross_amount_minor bigint, fee_amount_minor bigint, net_amount_minor bigint, "
        "currency string, provider_status string, captured_at timestamp_ntz")
REC = "id string, provider string, settlement_date date, validity string"
LINE = "settlement_record_id string, provider_transaction_id string, line_no bigint"

# family: (we have it, we captured it, settled, they have it, their changes, expected row after the subject key)
EGP, USD = "10000|300|9700|EGP", "10000|300|9700|USD"
FAMILIES = {
    "matched": f"MATCHED|{EGP}|SETTLED|{EGP}|SETTLED|0|false|[]",
    "notsettled": f"MATCHED_NOT_SETTLED|{EGP}|CAPTURED|{EGP}|CAPTURED|0|false|[]",
    "short": f"AMOUNT_MISMATCH|{EGP}|CAPTURED|9999|300|9699|EGP|CAPTURED|1|true|[AMOUNT_MISMATCH, AMOUNT_MISMATCH]",
    "currency": f"CURRENCY_MISMATCH|{EGP}|CAPTURED|{USD}|CAPTURED|-|true|[CURRENCY_MISMATCH]",
    "status": f"STATUS_MISMATCH|{EGP}|SETTLED|{EGP}|CAPTURED|0|true|[STATUS_MISMATCH]",
    "reference": f"REFERENCE_MISMATCH|{EGP}|CAPTURED|{EGP}|CAPTURED|0|true|[REFERENCE_MISMATCH]",
    "date": f"SETTLEMENT_DATE_MISMATCH|{EGP}|SETTLED|{EGP}|SETTLED|0|true|[SETTLEMENT_DATE_MISMATCH]",
    "onlyours": "MISSING_ON_PROVIDER|-|300|9700|EGP|CAPTURED|-|-|-|-|-|-|true|[MISSING_ON_PROVIDER]",
    "onlytheirs": "MISSING_INTERNAL|-|-|-|-|-|-|300|9700|EGP|CAPTURED|-|true|[MISSING_INTERNAL]",
    "uncaptured": "MISSING_INTERNAL|-|-|-|-|-|-|300|9700|EGP|CAPTURED|-|true|[MISSING_INTERNAL]",
}


def batch(spark):
    pays, prov, recs, lines = [], [], [], []
    for family in FAMILIES:
        for i in range(5):
            txn = f"psp_g_{family}_{i}"
            settled = family in ("matched", "status", "date")
            captured = family not in ("uncaptured",)
            rec = f"srec_{family}_{i}" if settled else None
            if family != "onlytheirs":
                pays.append((f"pay_{family}_{i}", "M", 10000, 300, 9700, "EGP", "SETTLED" if settled else "CAPTURED" if captured else "CREATED", P, txn, rec, NOW if captured else None))
            if family != "onlyours":
                g, n = (9999, 9699) if family == "short" else (10000, 9700)
                prov.append((f"x_{family}_{i}", P, txn, "OTHER" if family == "reference" else "M", g, 300, n, "USD" if family == "currency" else "EGP",
                             "SETTLED" if family in ("matched", "date") else "CAPTURED", NOW))
            if settled:
                recs.append((rec, P, TODAY - dt.timedelta(days=3) if family == "date" else TODAY, "VALID"))
                lines.append((rec, txn, 1))
            if family == "date":
                recs.append((f"again_{i}", P, TODAY, "VALID"))
                lines.append((f"again_{i}", txn, 1))
    return tuple(spark.createDataFrame(r, s) for r, s in ((pays, PAY), (prov, PROV), (recs, REC), (lines, LINE)))


def views(spark, pays, prov, recs, lines, window=WINDOW, mode=m.BOTH):
    made = postings.post_captures(pays.filter("captured_at is not null"))
    links = postings.link_payment_postings(made, made.limit(0), made.limit(0))
    ours = m.expected_view(pays, links, postings.headers(made), postings.entries(made), recs)
    return m.recon_population(pays, prov, recs, lines, window, mode), ours, m.provider_view(prov, recs, lines)


def results(spark, pays, prov, recs, lines, batch_id="b", window=WINDOW, mode=m.BOTH):
    return m.recon_results(m.classify_subjects(m.recon_subjects(*views(spark, pays, prov, recs, lines, window, mode))), batch_id)


def test_fifty_subjects(spark):
    lines = {r.line for r in m.golden_snapshot(results(spark, *batch(spark)), vocab.outcome_map(spark)).collect()}
    assert lines == {f"{P}:psp_g_{family}_{i}|{row}" for family, row in FAMILIES.items() for i in range(5)}


def test_modes(spark):
    data = batch(spark)
    pop = {mode: {(r.provider_transaction_id.split("_")[2], r.side) for r in m.recon_population(*data, WINDOW, mode).collect()} for mode in (m.INTERNAL, m.PROVIDER_ONLY, m.BOTH)}
    ours = set(FAMILIES) - {"onlytheirs", "uncaptured"}
    assert pop[m.INTERNAL] == {(f, "BOTH") for f in ours}
    assert pop[m.PROVIDER_ONLY] == {(f, "PROVIDER") for f in set(FAMILIES) - {"onlyours"}}
    assert pop[m.BOTH] == {(f, "BOTH") for f in ours} | {("onlytheirs", "PROVIDER"), ("uncaptured", "PROVIDER")}


def one(spark, pays=1, prov=1, settled=True, validity="VALID", **theirs):
    row = dict(reference="M", gross=10000, fee=300, net=9700, currency="EGP", status="SETTLED") | theirs
    p = [(f"p{i}", "M", 10000, 300, 9700, "EGP", "SETTLED", P, "t", "r" if settled else None, NOW) for i in range(pays)]
    x = [(f"x{i}", P, "t", row["reference"], row["gross"], row["fee"], row["net"], row["currency"], row["status"], NOW) for i in range(prov)]
    frames = [spark.createDataFrame(r, s) for r, s in ((p, PAY), (x, PROV), ([("r", P, TODAY, validity)], REC), ([("r", "t", 1)] if settled else [], LINE))]
    return results(spark, *frames).first()


def test_precedence(spark):
    assert one(spark, pays=2, prov=2).outcome == "DUPLICATE_PROVIDER_RECORD"
    assert one(spark, pays=0, prov=2).outcome == "DUPLICATE_PROVIDER_RECORD"
    assert one(spark, pays=0).outcome == "MISSING_INTERNAL"
    assert one(spark, pays=2, prov=0).outcome == "MISSING_ON_PROVIDER"
    assert one(spark, pays=2, validity="INVALID").outcome == "AMBIGUOUS_MATCH"
    broken = one(spark, validity="INVALID", gross=1)
    assert broken.outcome == "SETTLEMENT_RECORD_INVALID" and broken.reasons == ["AMOUNT_MISMATCH"] and broken.delta_minor == 9999
    clean = one(spark, validity="INVALID")
    assert clean.reasons == ["SETTLEMENT_RECORD_INVALID"] and clean.delta_minor == 0
    assert one(spark, currency="USD", gross=1, status="CAPTURED", reference="X").reasons == ["CURRENCY_MISMATCH", "STATUS_MISMATCH", "REFERENCE_MISMATCH"]
    assert one(spark, fee=301).delta_minor == 0
    assert one(spark).outcome == "MATCHED"
    assert one(spark, settled=False, status="CAPTURED").outcome == "MATCHED_NOT_SETTLED"


def test_control_characters_survive_in_differences(spark):
    import json
    odd = 'A\n"B"\t\\ é'
    found = json.loads(one(spark, reference=odd).differences)
    assert found == [{"reason": "REFERENCE_MISMATCH", "attribute": None, "expected": "M", "actual": odd, "deltaMinor": None}]


def test_never_captured_rows_enter_by_settlement_date(spark):
    end = dt.date(2024, 6, 1)
    prov = spark.createDataFrame([(f"x{i}", P, f"t{i}", "U", 1, 0, 1, "EGP", "SETTLED", None) for i in range(4)], PROV)
    recs = spark.createDataFrame([("r0", P, dt.date(2024, 5, 1), "VALID"), ("r1", P, end, "VALID"), ("r2", P, end + dt.timedelta(days=1), "VALID"), ("r3", "PSP_B", TODAY, "VALID")], REC)
    lines = spark.createDataFrame([(f"r{i}", f"t{i}", 1) for i in range(4)], LINE)
    got = {r.provider_transaction_id for r in m.recon_population_provider(prov, recs, lines, WINDOW).collect()}
    assert got == {"t0", "t1"}


def test_second_attempt_adds_only_what_is_missing(spark):
    data = batch(spark)
    all_rows = results(spark, *data)
    kept = all_rows.filter("subject_key like '%matched%'")
    population, ours, theirs = views(spark, *data)
    batch_id = all_rows.first().batch_id
    who = population.withColumn("batch_id", F.lit(batch_id))
    more = m.append_results(who, kept, ours, theirs, batch_id)
    assert more.count() == 45 and {tuple(r) for r in more.select("subject_key", "outcome").collect()} <= {tuple(r) for r in all_rows.select("subject_key", "outcome").collect()}
    assert m.append_results(who, all_rows, ours, theirs, batch_id).isEmpty()


def test_a_batch_belongs_to_one_provider(spark):
    data = batch(spark)
    assert m.recon_population(*data, WINDOW, m.BOTH, "PSP_B").isEmpty()
    assert m.recon_population(*data, WINDOW, m.BOTH, P).count() == 50


def test_second_run_reuses_every_case(spark):
    data = batch(spark)
    none = spark.createDataFrame([], "id string, batch_id string, result_id string, payment_id string, provider string, provider_transaction_id string, reason string, severity string, "
                                     "status string, occurrence_count bigint, detected_at timestamp_ntz")
    first = cases.cases_from_detections(cases.detections(results(spark, *data, "b1"), none), none, "2024-06-02 00:00:00")
    assert first.count() == 40
    found = cases.detections(results(spark, *data, "b2"), first)
    second = cases.cases_from_detections(found, first, "2024-06-03 00:00:00")
    assert {r.occurrence_count for r in second.collect()} == {2} and second.count() == 40
    counts = cases.detection_counts(found).first()
    assert (counts.cases_opened, counts.cases_reused) == (0, 40)
    numbers = sorted(r.case_number for r in cases.case_numbers(second).collect())
    assert numbers == list(range(1, 41))
