"""Settlement statements: coherence verdicts, totals, coverage and which record speaks for a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark import vocab


def settlement_line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("settlement_record_id").agg(
        F.sum("line_gross_minor").alias("line_gross"), F.sum("line_net_minor").alias("line_net"),
        (F.sum("line_gross_minor") - F.sum("line_net_minor")).alias("line_fee"),
        F.count(F.lit(1)).alias("line_count"),
    )


def total_problems_text() -> str:
    """SQL text listing every header total that contradicts the lines, joined with '; '."""
    return """concat_ws('; ',
        case when gross_amount_minor <> line_gross then concat('gross ', gross_amount_minor, ' against ', line_count, ' lines with ', line_gross) end,
        case when net_amount_minor <> line_net then concat('net ', net_amount_minor, ' against ', line_net) end,
        case when fee_amount_minor <> line_fee then concat('fee ', fee_amount_minor, ' against ', line_fee, ' (gross ', line_gross, ' − net ', line_net, ')') end)"""


def settlement_total_problems(records: DataFrame, lines: DataFrame) -> DataFrame:
    joined = records.join(settlement_line_totals(lines), records["id"] == F.col("settlement_record_id"))
    return joined.withColumn("problems", F.expr(total_problems_text())).filter("problems <> ''").select(
        "id", "provider_settlement_id", "problems")


def _line_facts(records: DataFrame, lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Per record: totals and the first line breaking each line rule.

    Lines are first combined per (record, transaction), where repeats show, then per record; both steps
    combine before their shuffle.  Payments meet the lines once per (provider, transaction).
    """
    at = F.col("line_no")
    per_txn = lines.groupBy("settlement_record_id", "provider_transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_no"),
        F.sum("line_gross_minor").alias("g"), F.sum("line_net_minor").alias("m"),
        F.min_by(F.struct("line_gross_minor", "line_net_minor"),
                 F.when((F.col("line_gross_minor") < 0) | (F.col("line_net_minor") < 0)
                        | (F.col("line_net_minor") > F.col("line_gross_minor")), at)).alias("bad"),
        F.min(F.when((F.col("line_gross_minor") < 0) | (F.col("line_net_minor") < 0)
                     | (F.col("line_net_minor") > F.col("line_gross_minor")), at)).alias("bad_no"),
    )
    ours = (
        payments.filter("provider_transaction_id is not null")
        .groupBy("provider", "provider_transaction_id")
        .agg(F.min("currency").alias("ccy_lo"), F.max("currency").alias("ccy_hi"))
    )
    owner = records.select(F.col("id").alias("settlement_record_id"), "provider", F.col("currency").alias("rec_ccy"))
    seen = (
        per_txn.join(owner, "settlement_record_id").join(ours, ["provider", "provider_transaction_id"], "left")
        .withColumn("other_ccy", F.expr("case when ccy_lo <> rec_ccy then ccy_lo when ccy_hi <> rec_ccy then ccy_hi end"))
    )
    txn = F.col("provider_transaction_id").alias("txn")
    return seen.groupBy(F.col("settlement_record_id").alias("id")).agg(
        F.sum("n").alias("line_count"), F.sum("g").alias("line_gross"), F.sum("m").alias("line_net"),
        F.min_by(F.struct(txn, "bad"), "bad_no").alias("bad"),
        F.min_by(F.struct(txn, F.col("other_ccy").alias("ccy")),
                 F.when(F.col("other_ccy").isNotNull(), F.col("first_no"))).alias("cross"),
        F.min_by(F.struct(txn, "n"), F.when(F.col("n") > 1, F.col("first_no"))).alias("twice"),
    ).withColumn("line_fee", F.expr("line_gross - line_net"))


def validate_settlements(records: DataFrame, lines: DataFrame, payments: DataFrame) -> DataFrame:
    """VALID / INVALID, the rule broken and a reason naming the first offending line.

    Order: no lines; negative total; per line in order negative amount or net above gross; unsupported
    currency; currency of a covered payment differs; repeated transaction; totals.
    """
    supported = ", ".join(f"'{c}'" for c in vocab.CURRENCIES)
    facts = records.join(_line_facts(records, lines, payments), "id", "left")
    facts = facts.withColumn("problems", F.expr(total_problems_text()))
    facts = facts.withColumn("rule", F.expr(f"""case
        when line_count is null then 'S1'
        when gross_amount_minor < 0 or fee_amount_minor < 0 or net_amount_minor < 0 then 'S7'
        when bad.bad.line_gross_minor < 0 or bad.bad.line_net_minor < 0 then 'S7'
        when bad.bad is not null then 'S5'
        when currency is null or upper(trim(currency)) not in ({supported}) then 'S8'
        when cross.txn is not null then 'S9'
        when twice.txn is not null then 'S6'
        when problems <> '' then 'S2-S4' end"""))
    reason = F.expr("""concat('settlement ', provider_settlement_id, case rule
        when 'S1' then ': no lines'
        when 'S7' then case when gross_amount_minor < 0 or fee_amount_minor < 0 or net_amount_minor < 0
            then concat(': total below zero, gross ', gross_amount_minor, ', fee ', fee_amount_minor, ', net ', net_amount_minor)
            else concat(' line ', bad.txn, ': amount below zero, gross ', bad.bad.line_gross_minor, ', net ', bad.bad.line_net_minor) end
        when 'S5' then concat(' line ', bad.txn, ': net ', bad.bad.line_net_minor, ' above gross ', bad.bad.line_gross_minor)
        when 'S8' then concat(': unsupported currency ', currency)
        when 'S9' then concat(': ', currency, ' settlement, transaction ', cross.txn, ' belongs to a ', cross.ccy, ' payment')
        when 'S6' then concat(': transaction ', twice.txn, ' listed ', twice.n, ' times')
        when 'S2-S4' then concat(': totals differ, ', problems) end)""")
    facts = facts.withColumn("reason", reason)
    return facts.select(
        "id", F.when(F.col("rule").isNull(), "VALID").otherwise("INVALID").alias("validity"),
        F.coalesce("rule", F.lit("-")).alias("rule"),
        F.col("reason").alias("validity_reason"),
    )


def latest_settlement_per_txn(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Date and validity from one and the same record: the latest date, then the highest id."""
    covering = lines.join(
        records.select(F.col("id").alias("settlement_record_id"), "provider", "settlement_date", "validity"),
        "settlement_record_id")
    return (
        covering.groupBy("provider", "provider_transaction_id")
        .agg(F.max_by(F.struct("settlement_date", "validity", "settlement_record_id"),
                      F.struct("settlement_date", "settlement_record_id")).alias("latest"))
        .select("provider", "provider_transaction_id", "latest.settlement_date", "latest.validity", "latest.settlement_record_id")
    )


def settlement_coverage(records: DataFrame, lines: DataFrame, payments: DataFrame) -> DataFrame:
    owner = records.select(F.col("id").alias("settlement_record_id"), "provider")
    ours = payments.filter("provider_transaction_id is not null").select(
        "provider", "provider_transaction_id", F.col("id").alias("payment_id"))
    return (
        lines.select("settlement_record_id", "provider_transaction_id", "line_no")
        .join(owner, "settlement_record_id").join(ours, ["provider", "provider_transaction_id"], "left")
        .select("settlement_record_id", "line_no", "provider", "provider_transaction_id", "payment_id",
                F.col("payment_id").isNull().alias("unknown_line"))
    )


def refused_settlements(records: DataFrame) -> DataFrame:
    return records.filter("validity = 'INVALID'").groupBy("provider", "currency").agg(
        F.count(F.lit(1)).alias("refused_records"), F.sum("gross_amount_minor").alias("refused_gross"),
        F.min("validity_reason").alias("first_reason"))


def settlement_reissues(records: DataFrame, lines: DataFrame) -> DataFrame:
    covering = lines.select("settlement_record_id", "provider_transaction_id").distinct().join(
        records.select(F.col("id").alias("settlement_record_id"), "provider"), "settlement_record_id")
    return (
        covering.groupBy("provider", "provider_transaction_id")
        .agg(F.count(F.lit(1)).alias("records"), F.min("settlement_record_id").alias("lowest_record"),
             F.max("settlement_record_id").alias("highest_record"))
        .filter("records > 1")
    )
