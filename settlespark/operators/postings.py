"""Balanced double-entry postings generated in bulk from business facts.

A posting is one row: its header columns plus ``legs``, an array of (account_code, direction,
amount_minor).  ``headers`` and ``entries`` turn postings into the two ledger tables.  A leg is never
left out, also when its amount is zero: ``validate_posting_commands`` reports that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from settlespark import vocab
from settlespark.functions.keyed import first_per_key

HEADER = [
    "id", "type", "state", "currency", "source_type", "source_id", "description",
    "reversal_of_transaction_id", "reversal_reason", "posted_at",
]
DEBIT, CREDIT = "DEBIT", "CREDIT"


def leg(account_code: str, direction: Column | str, amount: str) -> Column:
    way = F.lit(direction) if isinstance(direction, str) else direction
    return F.struct(F.lit(account_code).alias("account_code"), way.alias("direction"),
                    F.col(amount).cast("bigint").alias("amount_minor"))


def _posting(df: DataFrame, id_: Column, type_: str, currency: str, source_type: str, source_id: str,
             description: Column, posted_at: str, legs: list[Column]) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        id_.alias("id"), F.lit(type_).alias("type"), F.lit("POSTED").alias("state"),
        F.col(currency).alias("currency"), F.lit(source_type).alias("source_type"),
        F.col(source_id).alias("source_id"), description.alias("description"),
        none.alias("reversal_of_transaction_id"), none.alias("reversal_reason"),
        F.col(posted_at).alias("posted_at"), F.array(*legs).alias("legs"),
    )


def post_captures(payments: DataFrame) -> DataFrame:
    return _posting(
        payments, F.concat(F.lit("ltx_cap_"), "id"), "PAYMENT_CAPTURE", "currency", "PAYMENT", "id",
        F.concat(F.lit("Capture of payment "), "id"), "captured_at",
        [leg("PSP_CLEARING", DEBIT, "amount_minor"), leg("MERCHANT_PAYABLE", CREDIT, "net_amount_minor"),
         leg("PLATFORM_FEE_REVENUE", CREDIT, "platform_fee_minor")])


def post_settlements(records: DataFrame, payments: DataFrame) -> DataFrame:
    """One posting per VALID record over our own captured gross of the payments it settled.

    Amounts are summed per record before the join, so a record covering a third of all payments
    arrives as a single row.
    """
    settled = (
        payments.filter("settlement_record_id is not null")
        .groupBy(F.col("settlement_record_id").alias("id"), F.col("currency").alias("paid_currency"))
        .agg(F.sum("amount_minor").alias("settled_gross"))
    )
    facts = records.filter("validity = 'VALID'").join(settled, "id").withColumn(
        "at", F.col("settlement_date").cast("timestamp_ntz"))
    return _posting(
        facts, F.concat(F.lit("ltx_set_"), "id"), "SETTLEMENT_RECEIVED", "paid_currency", "SETTLEMENT_RECORD", "id",
        F.lit("Settlement received from the PSP"), "at",
        [leg("PLATFORM_CASH", DEBIT, "settled_gross"), leg("PSP_CLEARING", CREDIT, "settled_gross")])


def post_payouts(payouts: DataFrame) -> DataFrame:
    return _posting(
        payouts, F.concat(F.lit("ltx_po_"), "id"), "MERCHANT_PAYOUT", "currency", "PAYOUT", "id",
        F.concat(F.lit("Payout to merchant "), "merchant_reference"), "executed_at",
        [leg("MERCHANT_PAYABLE", DEBIT, "total_net_minor"), leg("PLATFORM_CASH", CREDIT, "total_net_minor")])


def post_refunds_after_settlement(refunds: DataFrame) -> DataFrame:
    return _posting(
        refunds, F.concat(F.lit("ltx_ref_"), "id"), "PAYMENT_REFUND_SETTLED", "currency", "PAYMENT", "id",
        F.concat(F.lit("Refund of settled payment "), "id"), "refunded_at",
        [leg("MERCHANT_PAYABLE", DEBIT, "net_amount_minor"), leg("PLATFORM_FEE_REVENUE", DEBIT, "platform_fee_minor"),
         leg("PLATFORM_CASH", CREDIT, "amount_minor")])


def post_psp_adjustments(adjustments: DataFrame) -> DataFrame:
    """``direction`` is the clearing leg's; cash takes the other side."""
    other = F.when(F.col("direction") == DEBIT, CREDIT).otherwise(DEBIT)
    return _posting(
        adjustments, F.concat(F.lit("ltx_adj_"), "case_id"), "PSP_ADJUSTMENT", "currency", "RECONCILIATION_CASE", "case_id",
        F.concat(F.lit("PSP adjustment for reconciliation case "), "case_id"), "posted_at",
        [leg("PSP_CLEARING", F.col("direction"), "amount_minor"), leg("PLATFORM_CASH", other, "amount_minor")])


def post_reversals(postings: DataFrame, requests: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """The exact mirror of each requested posting, once per original."""
    todo = first_per_key(requests.select("transaction_id", "reason", F.col("posted_at").alias("reversed_at")),
                         ["transaction_id"], ["reversed_at", "reason"])
    if already is not None:
        done = already.filter("type = 'REVERSAL'").select(F.col("reversal_of_transaction_id").alias("transaction_id"))
        todo = todo.join(done, "transaction_id", "left_anti")
    mirror = F.transform("legs", lambda x: F.struct(
        x["account_code"].alias("account_code"),
        F.when(x["direction"] == DEBIT, CREDIT).otherwise(DEBIT).alias("direction"),
        x["amount_minor"].alias("amount_minor")))
    return postings.join(todo, F.col("id") == F.col("transaction_id")).select(
        F.concat(F.lit("ltx_rev_"), "source_id").alias("id"), F.lit("REVERSAL").alias("type"), "state", "currency",
        "source_type", "source_id", F.concat(F.lit("Reversal of "), "id").alias("description"),
        F.col("id").alias("reversal_of_transaction_id"), F.col("reason").alias("reversal_reason"),
        F.col("reversed_at").alias("posted_at"), mirror.alias("legs"),
    )


def link_payment_postings(captures: DataFrame, refunds: DataFrame, reversals: DataFrame) -> DataFrame:
    def link(df: DataFrame, role: str) -> DataFrame:
        return df.select(F.col("source_id").alias("payment_id"), F.col("id").alias("ledger_transaction_id"),
                         F.lit(role).alias("role"))

    return link(captures, "CAPTURE").unionByName(link(refunds, "REFUND")).unionByName(link(reversals, "REVERSAL"))


def headers(postings: DataFrame) -> DataFrame:
    return postings.select(*HEADER)


def entries(postings: DataFrame, *also: str) -> DataFrame:
    """One row for each leg; ``also`` names columns of the posting to carry along."""
    ids = F.create_map(*[F.lit(v) for a in vocab.LEDGER_ACCOUNTS for v in (a[1], a[0])])
    flat = postings.select("id", "currency", "posted_at", *also, F.posexplode("legs").alias("pos", "leg"))
    return flat.select(
        F.concat(F.lit("le_"), "id", F.lit("_"), (F.col("pos") + 1).cast("string")).alias("id"),
        F.col("id").alias("transaction_id"), F.try_element_at(ids, F.col("leg.account_code")).alias("account_id"),
        F.col("leg.direction").alias("direction"), F.col("leg.amount_minor").alias("amount_minor"), "currency",
        F.col("leg.account_code").alias("account_code"), (F.col("pos") + 1).cast("bigint").alias("line_no"), "posted_at", *also,
    )


def drop_double_postings(headers_: DataFrame) -> DataFrame:
    """Keep the first of each (source_type, source_id, type); reversals are outside the rule."""
    guarded = headers_.filter("type <> 'REVERSAL'")
    kept = first_per_key(guarded, ["source_type", "source_id", "type"], ["posted_at", "id"])
    return kept.select(*headers_.columns).unionByName(headers_.filter("type = 'REVERSAL'"))


def reject_unpostable_entries(entries_: DataFrame, accounts: DataFrame) -> DataFrame:
    known = accounts.select(F.col("id").alias("account_id"), F.col("state").alias("account_state"))
    return (
        entries_.join(known, "account_id", "left")
        .withColumn("reject_reason", F.when(F.col("account_state").isNull(), "UNKNOWN_ACCOUNT")
                    .when(F.col("account_state") != "ACTIVE", "ACCOUNT_NOT_ACTIVE"))
        .filter("reject_reason is not null")
        .select(F.col("id").alias("entry_id"), "transaction_id", "account_id", "account_code", "reject_reason")
    )


def validate_posting_commands(headers_: DataFrame, entries_: DataFrame) -> DataFrame:
    """The first rule each command breaks; commands that break none are left out."""
    per = entries_.groupBy(F.col("transaction_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("amount_minor") == 0).alias("zero"), F.count_if(F.col("amount_minor") < 0).alias("negative"),
        F.min("currency").alias("lo"), F.max("currency").alias("hi"),
        F.sum(F.when(F.col("direction") == DEBIT, F.col("amount_minor")).otherwise(0)).alias("debits"),
        F.sum(F.when(F.col("direction") == CREDIT, F.col("amount_minor")).otherwise(0)).alias("credits"),
        F.count_if(F.col("direction") == DEBIT).alias("nd"), F.count_if(F.col("direction") == CREDIT).alias("nc"),
    )
    sources = ", ".join(f"'{s}'" for s in vocab.SOURCE_TYPES)
    rule = F.expr(f"""case
        when negative > 0 then 'NEGATIVE_ENTRY'
        when zero > 0 then 'ZERO_ENTRY'
        when coalesce(n, 0) < 2 then 'TOO_FEW_ENTRIES'
        when source_type is null or source_type not in ({sources}) then 'UNSUPPORTED_SOURCE'
        when lo <> currency or hi <> currency then 'L2_CURRENCY'
        when nd = 0 or nc = 0 then 'L3_ONE_SIDED'
        when debits <> credits then 'L1_UNBALANCED'
        when type = 'REVERSAL' and coalesce(trim(reversal_of_transaction_id), '') = '' then 'REVERSAL_WITHOUT_ORIGINAL'
        when type = 'REVERSAL' and coalesce(trim(reversal_reason), '') = '' then 'REVERSAL_WITHOUT_REASON'
        when type <> 'REVERSAL' and reversal_of_transaction_id is not null then 'REFERENCE_ON_NON_REVERSAL'
        end""")
    return (
        headers_.join(per, "id", "left").withColumn("failed_rule", rule).filter("failed_rule is not null")
        .select(F.col("id").alias("transaction_id"), "type", F.coalesce("n", F.lit(0)).cast("bigint").alias("entry_count"),
                F.coalesce("debits", F.lit(0)).alias("debits"), F.coalesce("credits", F.lit(0)).alias("credits"), "failed_rule")
    )
