"""Fees and money checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from settlespark import vocab
from settlespark.functions.keyed import first_per_key
from settlespark.functions.money import amount_problem, half_up_fee, money_text
from settlespark.vocab import dimension


OTHER = "-"


def fee_split(df: DataFrame, amount: str = "amount_minor", bps: str = "bps") -> DataFrame:
    return df.withColumn("fee_minor", half_up_fee(amount, bps)).withColumn("net_minor", F.expr(f"{amount} - fee_minor"))


def select_fee_policy(payments: DataFrame, policies: DataFrame) -> DataFrame:
    """The active policy in the payment's currency, else the active ``DEFAULT`` one.

    Which policy a currency gets is settled on one row per currency of the fixed vocabulary, and one for any other; payments then take
    a single equi-join with those few rows.
    """
    active = policies.filter("active").select(
        F.col("id").alias("policy_id"), F.col("code").alias("policy_code"), F.col("bps").alias("policy_bps"), F.col("currency").alias("policy_currency"))
    own = first_per_key(active, ["policy_currency"], ["policy_id"])
    fallback = active.filter("policy_code = 'DEFAULT'").select(
        F.col("policy_code").alias("fallback_code"), F.col("policy_id").alias("default_id"), F.col("policy_bps").alias("default_bps"))
    currencies = dimension(payments.sparkSession, [(c,) for c in (*vocab.CURRENCIES, OTHER)], "choice_key").withColumn("fallback_code", F.lit("DEFAULT"))
    choice = (
        currencies.join(own, F.col("choice_key") == F.col("policy_currency"), "left").join(fallback, "fallback_code", "left")
        .select("choice_key", F.coalesce("policy_id", "default_id").alias("fee_policy_id"),
                F.coalesce("policy_code", F.expr("case when default_id is not null then fallback_code end")).alias("fee_policy_code"),
                F.coalesce("policy_bps", "default_bps").alias("bps"))
    )
    key = F.when(F.col("currency").isin(*vocab.CURRENCIES), F.col("currency")).otherwise(F.lit(OTHER))
    return payments.withColumn("choice_key", key).join(F.broadcast(choice), "choice_key", "left").drop("choice_key")


def money_violations(df: DataFrame, amount: str = "amount_minor", on_create: bool = True) -> DataFrame:
    problem = amount_problem(F.col(amount))
    if on_create:
        problem = F.coalesce(problem, F.when(F.col(amount) == 0, "ZERO_GROSS"))
    return df.withColumn("problem", problem).filter("problem is not null")


def money_display(df: DataFrame, currency: str = "currency", amount: str = "amount_minor") -> DataFrame:
    return df.withColumn("display", money_text(currency, amount))


def split_violations(payments: DataFrame, provider_rows: DataFrame, records: DataFrame) -> DataFrame:
    def broken(df: DataFrame, source: str, gross: str, fee: str, net: str) -> DataFrame:
        return df.filter(f"{gross} <> {net} + {fee}").select(
            F.lit(source).alias("source"), "id", F.col(gross).alias("gross_minor"), F.col(fee).alias("fee_minor"), F.col(net).alias("net_minor"))

    stated = ("gross_amount_minor", "fee_amount_minor", "net_amount_minor")
    return (
        broken(payments, "PAYMENT", "amount_minor", "platform_fee_minor", "net_amount_minor")
        .unionByName(broken(provider_rows, "PROVIDER_TRANSACTION", *stated))
        .unionByName(broken(records.filter("validity = 'VALID'"), "SETTLEMENT_RECORD", *stated))
    )
