"""Ledger and schema invariants as violation queries: an empty result means the invariant holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.functions.keyed import repeated_keys
from settlespark.functions.ordered import running_sums


def _total(direction: str) -> Column:
    return F.sum(F.when(F.col("direction") == direction, F.col("amount_minor")).otherwise(0))


def ledger_unbalanced(entries: DataFrame) -> DataFrame:
    return (
        entries.groupBy("transaction_id").agg(_total("DEBIT").alias("debits"), _total("CREDIT").alias("credits"))
        .filter("debits <> credits").withColumn("difference", F.expr("debits - credits"))
    )


def ledger_currency_breaks(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """Currencies are reduced to different ones by hash before the shuffle; only those of broken transactions are sorted."""
    used = entries.select("transaction_id", F.col("currency").alias("used")).distinct()
    joined = headers.select(F.col("id").alias("transaction_id"), F.col("currency").alias("header_currency")).join(used, "transaction_id")
    broken = joined.filter("used <> header_currency").select("transaction_id", "header_currency").distinct()
    return joined.join(broken, ["transaction_id", "header_currency"], "left_semi").groupBy("transaction_id", "header_currency").agg(
        F.min("used").alias("lowest"), F.max("used").alias("highest")).withColumn("mixed", F.expr("lowest <> highest"))


def ledger_shape_breaks(entries: DataFrame) -> DataFrame:
    lines = entries.groupBy("transaction_id", "line_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") == "DEBIT").alias("nd"),
        F.count_if(F.col("direction") == "CREDIT").alias("nc"), F.min("amount_minor").alias("least"))
    per = lines.groupBy("transaction_id").agg(
        F.sum("n").alias("entry_count"), F.sum("nd").alias("nd"), F.sum("nc").alias("nc"), F.min("least").alias("least"),
        F.min("line_no").alias("first_line"), F.max("n").alias("most"))
    problems = F.expr("""concat_ws(',', case when entry_count < 2 then 'TOO_FEW' end, case when nd = 0 or nc = 0 then 'ONE_SIDED' end,
        case when least <= 0 then 'AMOUNT_NOT_POSITIVE' end, case when first_line < 1 or most > 1 then 'LINE_NUMBERS' end)""")
    return per.withColumn("problems", problems).filter("problems <> ''").select("transaction_id", "entry_count", "problems")


def ledger_empty_headers(headers: DataFrame, entries: DataFrame) -> DataFrame:
    per = entries.groupBy(F.col("transaction_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        headers.filter("state = 'POSTED'").join(per, "id", "left").withColumn("entry_count", F.coalesce("n", F.lit(0)).cast("bigint"))
        .filter("entry_count < 2").select(F.col("id").alias("transaction_id"), "type", "entry_count")
    )


def ledger_account_code_breaks(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    named = accounts.select(F.col("id").alias("account_id"), F.col("code").alias("real_code"))
    return entries.join(named, "account_id").filter("account_code <> real_code").select(
        F.col("id").alias("entry_id"), "account_id", "account_code", "real_code")


def ledger_double_reversals(headers: DataFrame) -> DataFrame:
    return repeated_keys(headers.filter("reversal_of_transaction_id is not null and type = 'REVERSAL'"),
                         ["reversal_of_transaction_id"], "reversals")


def ledger_reversal_shape_breaks(headers: DataFrame) -> DataFrame:
    problem = F.expr("""case when type = 'REVERSAL' and reversal_of_transaction_id is null then 'NO_ORIGINAL'
        when type = 'REVERSAL' and reversal_reason is null then 'NO_REASON'
        when type <> 'REVERSAL' and reversal_of_transaction_id is not null then 'NOT_A_REVERSAL'
        when reversal_of_transaction_id = id then 'REVERSES_ITSELF' end""")
    return headers.withColumn("problem", problem).filter("problem is not null").select("id", "type", "problem")


def ledger_reversal_not_mirror(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """Reversals whose flipped entries differ from the original's as a multiset."""
    legs = entries.groupBy("transaction_id", "account_id", "direction", "amount_minor").agg(F.count(F.lit(1)).alias("n"))
    pairs = headers.filter("type = 'REVERSAL' and reversal_of_transaction_id is not null").select(
        F.col("id").alias("reversal_id"), "reversal_of_transaction_id")
    original = legs.join(pairs, F.col("transaction_id") == F.col("reversal_of_transaction_id")).select(
        "reversal_id", "account_id", "direction", "amount_minor", "n", F.lit(1).alias("side"))
    flipped = legs.join(pairs, F.col("transaction_id") == F.col("reversal_id")).select(
        "reversal_id", "account_id", F.expr("case direction when 'DEBIT' then 'CREDIT' else 'DEBIT' end").alias("direction"),
        "amount_minor", "n", F.lit(-1).alias("side"))
    both = original.unionByName(flipped).groupBy("reversal_id", "account_id", "direction", "amount_minor").agg(
        F.sum(F.col("n") * F.col("side")).alias("surplus"))
    return both.filter("surplus <> 0").groupBy("reversal_id").agg(
        F.sum(F.expr("case when surplus > 0 then surplus else 0 end")).alias("missing"),
        F.sum(F.expr("case when surplus < 0 then -surplus else 0 end")).alias("unexpected"))


def asset_negative_balances(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Entries after which an asset account stands below zero.  A handful of accounts carry all entries,
    so the running sum goes over slices of an account rather than the account."""
    assets = accounts.filter("account_type = 'ASSET'").select(F.col("id").alias("account_id"), "normal_side")
    signed = entries.join(assets, "account_id").select(
        "account_id", "currency", "posted_at", "transaction_id", "line_no",
        F.expr("case when direction = normal_side then amount_minor else -amount_minor end").alias("signed_minor"))
    run = running_sums(signed, ["account_id", "currency"], ["posted_at", "transaction_id", "line_no"], {"balance_minor": F.col("signed_minor")})
    return run.filter("balance_minor < 0")


def ledger_double_postings(headers: DataFrame) -> DataFrame:
    return repeated_keys(headers.filter("type <> 'REVERSAL'"), ["source_type", "source_id", "type"])


def payout_double_payments(payout_lines: DataFrame) -> DataFrame:
    return repeated_keys(payout_lines, ["payment_id"])


def payment_row_violations(payments: DataFrame) -> DataFrame:
    problems = F.expr("""concat_ws(',', case when (state = 'FAILED') <> (failure_code is not null) then 'FAILURE_CODE' end,
        case when amount_minor <> net_amount_minor + platform_fee_minor then 'SPLIT' end)""")
    return payments.withColumn("problems", problems).filter("problems <> ''").select("id", "state", "failure_code", "problems")


def payout_row_violations(records: DataFrame, lines: DataFrame) -> DataFrame:
    per = lines.groupBy(F.col("payout_record_id").alias("id")).agg(
        F.sum("line_net_minor").alias("lines_net"), F.count(F.lit(1)).alias("lines"))
    problems = F.expr("""concat_ws(',',
        case when status = 'EXECUTED' and (ledger_transaction_id is null or executed_at is null) then 'EXECUTED_UNPROVEN' end,
        case when total_net_minor <> coalesce(lines_net, 0) then 'TOTAL' end, case when line_count <> coalesce(lines, 0) then 'LINE_COUNT' end)""")
    return records.join(per, "id", "left").withColumn("problems", problems).filter("problems <> ''").select(
        "id", "total_net_minor", F.coalesce("lines_net", F.lit(0)).alias("lines_net"), "line_count", F.coalesce("lines", F.lit(0)).alias("lines"), "problems")


def settlement_row_violations(records: DataFrame) -> DataFrame:
    problems = F.expr("""concat_ws(',', case when validity = 'VALID' and validity_reason is not null then 'VALID_WITH_REASON' end,
        case when validity = 'INVALID' and validity_reason is null then 'INVALID_WITHOUT_REASON' end,
        case when validity = 'VALID' and gross_amount_minor <> net_amount_minor + fee_amount_minor then 'SPLIT' end)""")
    return records.withColumn("problems", problems).filter("problems <> ''").select("id", "validity", "problems")


def case_row_violations(cases: DataFrame) -> DataFrame:
    problem = F.expr("""case
        when status in ('RESOLVED', 'WRITTEN_OFF') and length(coalesce(resolution_note, '')) < 20 then 'CLOSED_WITHOUT_NOTE'
        when status in ('RESOLVED', 'WRITTEN_OFF') and resolved_at is null then 'CLOSED_WITHOUT_TIME'
        when status in ('OPEN', 'INVESTIGATING') and resolved_at is not null then 'OPEN_WITH_TIME' end""")
    return cases.withColumn("problem", problem).filter("problem is not null").select("id", "status", "problem")


def _per_table(entries: list[tuple], at: int) -> list[tuple[DataFrame, list[tuple]]]:
    """The entries of each table together, so that every table is read once for all its constraints."""
    tables: dict[int, tuple[DataFrame, list[tuple]]] = {}
    for entry in entries:
        tables.setdefault(id(entry[at]), (entry[at], []))[1].append(entry)
    return list(tables.values())


def foreign_key_orphans(relations: list[tuple[str, DataFrame, Column, str, DataFrame, str]]) -> DataFrame:
    """``relations``: (name, child, child row id, child column, parent, parent column).

    All references are one anti-join of different (parent, key) pairs.  The keys of the children are reduced to different ones in the task that
    reads them, so a parent with a third of all children is one row; only children of missing parents are looked up afterwards.
    """
    parents = {(id(parent), key): (n, parent) for n, (*_, parent, key) in enumerate(relations)}
    known = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("parent"), F.col(key).cast("string").alias("key")) for (_, key), (n, df) in parents.items()])

    def children(*extra) -> DataFrame:
        parts = []
        for child, own in _per_table(relations, 1):
            links = F.array(*[
                F.struct(F.lit(parents[id(parent), key][0]).alias("parent"), F.col(column).cast("string").alias("key"), *[e(name, row_id) for e in extra])
                for name, _, row_id, column, parent, key in own])
            parts.append(child.select(F.explode(links).alias("l")).select("l.*").filter("key is not null"))
        return reduce(DataFrame.unionByName, parts)

    missing = children().distinct().join(known, ["parent", "key"], "left_anti")
    told = children(lambda name, _: F.lit(name).alias("relation"), lambda _, row_id: row_id.cast("string").alias("child_id"))
    return told.join(missing, ["parent", "key"], "left_semi").select("relation", "child_id", F.col("key").alias("missing_parent"))


def unique_key_breaks(keys: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """``keys``: (name, rows the key applies to, key columns).

    Each table is read once, and all keys of all tables are counted in one aggregate by (key number, values), combined in the task that reads
    them.  The only thing the aggregate changes is a count, so it hashes and never sorts a table, and a value that comes very often is one row a task.
    """
    parts, names = [], []
    for df, own in _per_table(keys, 1):
        values = F.array(*[
            F.struct(F.lit(len(names) + i).alias("no"), F.array(*[F.col(c).cast("string") for c in cols]).alias("values"))
            for i, (_, _, cols) in enumerate(own)])
        names += [name for name, *_ in own]
        parts.append(df.select(F.explode(values).alias("k")).select("k.*"))
    again = reduce(DataFrame.unionByName, parts).groupBy("no", "values").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return again.select(F.element_at(F.array(*map(F.lit, names)), F.col("no") + 1).alias("key_name"), F.concat_ws("|", "values").alias("key_value"), "n")


def history_mutations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that were changed or removed between two snapshots; new rows are fine."""
    columns = [c for c in before.columns if c != "id"]
    now = after.select("id", *[F.col(c).alias(f"_now_{c}") for c in columns], F.lit(True).alias("_there"))
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_now_{c}"))
    joined = before.join(now, "id", "left").filter(F.col("_there").isNull() | changed)
    return joined.select("id", F.expr("case when _there is null then 'DELETED' else 'CHANGED' end").alias("mutation"))


def enum_violations(columns: list[tuple[str, DataFrame, str, str | Column, list[str]]]) -> DataFrame:
    """``columns``: (name, rows, row id column, checked column or expression, vocabulary).  Each table is read once; nothing is shuffled."""
    parts = []
    for df, own in _per_table(columns, 1):
        found = []
        for name, _, row_id, column, vocabulary in own:
            value = F.col(column) if isinstance(column, str) else column
            found.append(F.when(value.isNotNull() & ~value.isin(vocabulary), F.struct(
                F.lit(name).alias("column_name"), F.col(row_id).alias("row_id"), value.alias("value"))))
        parts.append(df.select(F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("v")).select("v.*"))
    return reduce(DataFrame.unionByName, parts)
