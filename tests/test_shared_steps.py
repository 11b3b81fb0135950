"""Steps that many queries share make only what is asked for, and make it once."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from settlespark.operators import checks, ingest, matching as m
from settlespark.plans import attacks, audit_ops, cases, events, matching
from settlespark.plans.registry import all_queries
from settlespark.sources.scenario import Scenario, WEBHOOK_SECRET


def test_audit_of_one_type_needs_its_own_tables_only(scenario, monkeypatch):
    every = audit_ops.audit_events(scenario)
    wanted = {t: every.filter(f"entity_type = '{t}'").collect() for t in ("PAYMENT", "SETTLEMENT_RECORD")}

    def never(*_):
        raise AssertionError("results and cases tell of no payment and no settlement")

    monkeypatch.setattr(cases, "results_of", never)
    monkeypatch.setattr(cases, "cases_b", never)
    for entity_type, rows in wanted.items():
        some = audit_ops.audit_events(scenario, entity_type).collect()
        assert rows and sorted(some, key=lambda r: r.id) == sorted(rows, key=lambda r: r.id)


def test_deliveries_are_parsed_and_signed_once(scenario):
    marked = ingest.classify_deliveries(scenario.deliveries, WEBHOOK_SECRET)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "sha2" not in plan

    accepted = events.classified(scenario).filter("outcome = 'ACCEPTED'").drop("outcome", "http_status")
    again = ingest.parse_provider_events(accepted)
    told = ingest.parse_provider_events(accepted, accepted=True)
    assert told.dtypes == again.dtypes
    assert sorted(map(str, told.collect())) == sorted(map(str, again.collect()))
    assert again.filter("reject_reason is not null").isEmpty()
    assert told._jdf.queryExecution().optimizedPlan().toString().count("from_json") < again._jdf.queryExecution().optimizedPlan().toString().count("from_json")


def test_a_domain_table_of_one_task_is_read_by_many(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    kept = Scenario(spark, str(tmp_path)).keep("groups", lambda: rows)
    (file,) = kept.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).num_row_groups > 2
    assert kept.agg(F.count("text"), F.sum("id")).first() == (200_000, sum(range(200_000)))


def test_batches_share_both_sides(spark, scenario):
    ours, theirs = matching.sides(scenario)
    who = matching.population(scenario).unionByName(
        spark.createDataFrame([("P", "nobody", "BOTH", "P:nobody")], "provider string, provider_transaction_id string, side string, subject_key string"))
    shared = m.subjects_beside(who, m.subject_sides(ours, theirs))
    direct = m.recon_subjects(who, ours, theirs)
    assert shared.dtypes == direct.dtypes
    assert sorted(map(str, shared.collect())) == sorted(map(str, direct.collect()))
    plan = matching.subjects(scenario)._jdf.queryExecution().optimizedPlan().toString()
    assert "account_code" not in plan


def test_ledger_checks_read_one_stored_table_and_join_nothing(spark, scenario):
    """Legs know the type and source of their posting: bending them needs neither a join nor tables of their own."""
    entries = attacks.entries(scenario)
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_currency_breaks_sort_only_broken_transactions(spark):
    headers = spark.createDataFrame([("a", "EGP"), ("b", "EGP"), ("c", "USD")], "id string, currency string")
    entries = spark.createDataFrame([("a", "EGP"), ("a", "JPY"), ("b", "EGP"), ("b", "EGP"), ("c", "EUR")], "transaction_id string, currency string")
    found = checks.ledger_currency_breaks(headers, entries)
    assert sorted(map(tuple, found.collect())) == [("a", "EGP", "EGP", "JPY", True), ("c", "USD", "EUR", "EUR", False)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") > plan.count("SortAggregate") and "min(currency" not in plan


def test_answered_subjects_are_those_of_the_stored_results(scenario, monkeypatch):
    wanted = sorted(tuple(r) for r in matching._stored_b(scenario).select("batch_id", "subject_key").collect())
    assert wanted and sorted(tuple(r) for r in matching._answered_b(scenario).collect()) == wanted

    def never(*_):
        raise AssertionError("what is left to do is told without classifying anything")

    monkeypatch.setattr(matching, "results_b", never)
    assert all_queries()["unprocessed_subjects"](scenario.spark, scenario.sf_dir).count() > 0


def test_timelines_of_all_payments_are_not_sorted_as_a_whole(spark, scenario):
    """SQL asks for no order of all timelines; the one of a payment is sorted."""
    everyone = all_queries()["payment_timeline"](spark, scenario.sf_dir)
    assert "Sort [" not in everyone._jdf.queryExecution().optimizedPlan().toString()
