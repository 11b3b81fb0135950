"""Ledger reads: balances, trial balance, drift, statements and nested views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIGNED = "case when direction = normal_side then amount_minor else -amount_minor end"


def seed_balances(accounts: DataFrame, currencies: DataFrame) -> DataFrame:
    """Every account in every active currency at zero: the product of two fixed vocabularies."""
    per_account = F.array_sort(F.collect_list("code"))
    active = currencies.filter("active").agg(per_account.alias("codes"))
    return (
        accounts.select(F.col("id").alias("account_id"), F.lit(1).alias("_one"))
        .join(F.broadcast(active.withColumn("_one", F.lit(1))), "_one")
        .select("account_id", F.explode("codes").alias("currency"), F.lit(0).cast("bigint").alias("balance_minor"), F.lit(0).cast("bigint").alias("entry_count"))
    )


def _recomputed(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    sides = accounts.select(F.col("id").alias("account_id"), "normal_side")
    return (
        entries.join(sides, "account_id").groupBy("account_id", "currency")
        .agg(F.sum(F.expr(SIGNED)).alias("balance_minor"), F.count(F.lit(1)).alias("entry_count"), F.max("posted_at").alias("last_entry_at"))
    )


def account_balances(entries: DataFrame, accounts: DataFrame, currencies: DataFrame) -> DataFrame:
    """Balance in each account's normal direction.  Few groups, so combining before the shuffle
    leaves a row per account and currency per task."""
    seeds = seed_balances(accounts, currencies).select("account_id", "currency")
    return seeds.join(_recomputed(entries, accounts), ["account_id", "currency"], "full_outer").select(
        "account_id", "currency", F.coalesce("balance_minor", F.lit(0)).cast("bigint").alias("balance_minor"),
        F.coalesce("entry_count", F.lit(0)).cast("bigint").alias("entry_count"), "last_entry_at")


def trial_balance(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Debits, credits and their difference per currency and account type, with the currency's own total."""
    types = accounts.select(F.col("id").alias("account_id"), "account_type")
    return (
        entries.join(types, "account_id").rollup("currency", "account_type")
        .agg(F.sum(F.expr("case when direction = 'DEBIT' then amount_minor else 0 end")).alias("debits"),
             F.sum(F.expr("case when direction = 'CREDIT' then amount_minor else 0 end")).alias("credits"))
        .filter("currency is not null")
        .select("currency", F.coalesce("account_type", F.lit("ALL")).alias("account_type"), "debits", "credits",
                F.expr("debits - credits").alias("difference"))
    )


def _compared(stored: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    kept = stored.select("account_id", "currency", F.col("balance_minor").alias("projected_minor"), F.col("entry_count").alias("projected_count"))
    real = _recomputed(entries, accounts).select(
        "account_id", "currency", F.col("balance_minor").alias("recomputed_minor"), F.col("entry_count").alias("actual_count"))
    names = accounts.select(F.col("id").alias("account_id"), F.col("code").alias("account_code"))
    joined = kept.join(real, ["account_id", "currency"], "full_outer").join(names, "account_id")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("projected_minor", "projected_count", "recomputed_minor", "actual_count")}
    return joined.withColumn("has_projection", F.col("projected_count").isNotNull()).withColumns(zero)


def verify_balances(stored: DataFrame, entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Stored balances that differ from the entries, and entries without any stored balance."""
    return (
        _compared(stored, entries, accounts)
        .filter("projected_minor <> recomputed_minor or projected_count <> actual_count or (not has_projection and actual_count > 0)")
        .select("account_code", "currency", "projected_minor", "recomputed_minor", "projected_count", "actual_count",
                F.expr("projected_minor - recomputed_minor").alias("delta_minor"), F.expr("projected_count = 0 and actual_count > 0").alias("missing_projection"))
    )


def account_view(stored: DataFrame, entries: DataFrame, accounts: DataFrame, account_code: str, currency: str) -> DataFrame:
    one = accounts.filter(F.col("code") == account_code)
    mine = entries.filter((F.col("account_code") == account_code) & (F.col("currency") == currency))
    kept = stored.join(one.select(F.col("id").alias("account_id")), "account_id", "left_semi").filter(F.col("currency") == currency)
    return _compared(kept, mine, one).select(
        "account_code", "currency", "projected_minor", "recomputed_minor", "actual_count",
        F.expr("projected_minor = recomputed_minor and projected_count = actual_count").alias("verified"))


def page(df: DataFrame, at: str, columns: list[str], limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """Newest first by (``at``, id), strictly after the cursor; one row of look-ahead sets ``has_more``."""
    if after is not None:
        df = df.filter(F.struct(at, "id") < F.struct(F.lit(after[0]).cast("timestamp_ntz").alias(at), F.lit(after[1]).alias("id")))
    newest = [F.col(at).desc(), F.col("id").desc()]
    ahead = df.orderBy(*newest).limit(limit + 1)
    # The window sees at most limit + 1 rows.
    seen = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return ahead.withColumn("has_more", seen > limit).orderBy(*newest).limit(limit).select(*columns, "has_more")


def account_statement_page(entries: DataFrame, account_code: str, currency: str, limit: int = 50,
                           after: tuple[str, str] | None = None) -> DataFrame:
    mine = entries.filter((F.col("account_code") == account_code) & (F.col("currency") == currency))
    return page(mine, "posted_at", ["id", "transaction_id", "direction", "amount_minor", "posted_at"], limit, after)


def nested_entries() -> Column:
    """The entries of one transaction in line order.  Line numbers are unique per transaction and fit a 16-bit
    number by the schema, which bounds the list."""
    return F.to_json(F.array_sort(F.collect_list(F.struct("line_no", "account_code", "direction", "amount_minor"))))


def transaction_with_entries(headers: DataFrame, entries: DataFrame) -> DataFrame:
    nested = entries.groupBy(F.col("transaction_id").alias("id")).agg(nested_entries().alias("entries"))
    return headers.select("id", "type", "currency", "source_type", "source_id", "posted_at").join(nested, "id", "left")


def list_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy("code")


def payment_ledger_story(links: DataFrame, headers: DataFrame, entries: DataFrame, payment_id: str | None = None) -> DataFrame:
    """Every posting and entry of one payment, or of all."""
    if payment_id is not None:
        links = links.filter(F.col("payment_id") == payment_id)
    lines = entries.select("transaction_id", "line_no", "account_code", "direction", "amount_minor")
    posted = headers.select(F.col("id").alias("transaction_id"), "type", "posted_at")
    return (
        links.withColumnRenamed("ledger_transaction_id", "transaction_id").join(posted, "transaction_id").join(lines, "transaction_id")
        .select("payment_id", "role", "transaction_id", "type", "posted_at", "line_no", "account_code", "direction", "amount_minor")
        .orderBy("payment_id", "posted_at", "transaction_id", "line_no")
    )
