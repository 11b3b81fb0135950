"""Payout requests: checks, planning, cash, nested view and history.

A request is a header (payout_id, merchant_reference, requested_at) and its lines (payout_id, payment_id),
so a merchant with any number of payments is many rows and never one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from settlespark.functions.ordered import SLICE, row_numbers, sliced
from settlespark.vocab import dimension


def payout_request_checks(requests: DataFrame, lines: DataFrame, payments: DataFrame, paid_lines: DataFrame) -> DataFrame:
    """The first failing rule of each whole request: no ids, a repeated id, an unknown id, the first payment (by id)
    that is not settled or already paid, another merchant's payment, mixed currencies."""
    asked = lines.groupBy("payout_id", "payment_id").agg(F.count(F.lit(1)).alias("times"))
    paid = paid_lines.select("payment_id").distinct().withColumn("paid", F.lit(True))
    known = payments.select(F.col("id").alias("payment_id"), "state", "currency", "net_amount_minor", F.col("merchant_reference").alias("owner")).join(
        paid, "payment_id", "left").withColumn("problem", F.expr("case when state <> 'SETTLED' then 'NOT_SETTLED' when paid then 'ALREADY_PAID' end"))
    # Combined per request and owning merchant first: only then does the request's own merchant come in,
    # by a join that a request with a third of all lines enters as a few rows.
    per_owner = asked.join(known, "payment_id", "left").groupBy("payout_id", "owner").agg(
        F.sum("times").alias("asked"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("state").isNull()).alias("unknown"),
        F.min(F.when(F.col("state").isNull(), F.col("payment_id"))).alias("unknown_id"), F.min("payment_id").alias("first_id"),
        F.min_by(F.struct("payment_id", "problem"), F.when(F.col("problem").isNotNull(), F.col("payment_id"))).alias("bad"),
        F.min("currency").alias("lo"), F.max("currency").alias("hi"), F.min_by("currency", "payment_id").alias("first_currency"),
        F.sum("net_amount_minor").alias("net"))
    per = per_owner.join(requests.select("payout_id", "merchant_reference"), "payout_id").groupBy("payout_id").agg(
        F.sum("asked").alias("asked"), F.sum("ids").alias("ids"), F.sum("unknown").alias("unknown"), F.min("unknown_id").alias("unknown_id"),
        F.min("bad").alias("bad"), F.min(F.when(F.col("owner") != F.col("merchant_reference"), F.col("first_id"))).alias("foreign_id"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("first_currency", "first_id").alias("currency"), F.sum("net").alias("total_net_minor"))
    verdict = F.expr("""case when ids is null then 'EMPTY' when asked > ids then 'REPEATED_ID' when unknown > 0 then 'NOT_FOUND'
        when bad.problem is not null then bad.problem when foreign_id is not null then 'MERCHANT_MISMATCH'
        when lo <> hi then 'CURRENCY_MISMATCH' else 'ACCEPTED' end""")
    joined = requests.join(per, "payout_id", "left").withColumn("verdict", verdict)
    return joined.select(
        "payout_id", "merchant_reference", "verdict",
        F.expr("case verdict when 'NOT_FOUND' then unknown_id when 'NOT_SETTLED' then bad.payment_id when 'ALREADY_PAID' then bad.payment_id "
               "when 'MERCHANT_MISMATCH' then foreign_id end").alias("offending_payment"),
        F.coalesce("ids", F.lit(0)).cast("bigint").alias("payment_count"),
        F.expr("case when verdict = 'ACCEPTED' then currency end").alias("currency"),
        F.expr("case when verdict = 'ACCEPTED' then total_net_minor end").alias("total_net_minor"))


def build_payouts(checks: DataFrame, lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Numbered lines, in payment-id order, of every accepted request, with its totals beside them."""
    accepted = checks.filter("verdict = 'ACCEPTED'").select("payout_id", "merchant_reference", "currency", "total_net_minor", F.col("payment_count").alias("line_count"))
    net = payments.select(F.col("id").alias("payment_id"), F.col("net_amount_minor").alias("line_net_minor"))
    rows = lines.select("payout_id", "payment_id").join(accepted, "payout_id").join(net, "payment_id")
    return row_numbers(rows, ["payout_id"], ["payment_id"], "line_no")


#: Powers of two told of every slice in one pass; at most 63 / POWERS passes, and one unless the cash falls by more than 2^POWERS.
POWERS = 8


def _slice_facts(asks: DataFrame, powers: list[tuple[str, int]]) -> DataFrame:
    """Per (currency, slice), for the currency's own power (currency, p) and the next lower ones j = p - k, what decides a whole slice while
    2^j to 2^(j+1) is left.

    ``below_k``: the sum of the requests under 2^j, all of which fit then.  ``need_k``: the least that must be left at the start of the slice
    for one of the requests from 2^j on, but under 2^(j+1), to fit: its own amount and the smaller ones before it.
    """
    rows = asks.join(F.broadcast(dimension(asks.sparkSession, powers, "currency, p")), "currency").withColumn("k", F.expr("cast(p - length(bin(ask)) + 1 as int)"))
    order = Window.partitionBy("currency", SLICE).orderBy("payout_id").rowsBetween(Window.unboundedPreceding, -1)
    small = [F.expr(f"case when ask = 0 or k > {k} then ask else 0 end") for k in range(POWERS)]
    for k, x in enumerate(small):
        rows = rows.withColumn(f"before_{k}", F.coalesce(F.sum(x).over(order), F.lit(0)))
    return rows.groupBy("currency", SLICE).agg(
        *[F.sum(x).alias(f"below_{k}") for k, x in enumerate(small)],
        *[F.min(F.expr(f"case when ask > 0 and k = {k} then before_{k} + ask end")).alias(f"need_{k}") for k in range(POWERS)])


def _through_slice(asks: DataFrame, currency: str, at: int, left: int):
    """One slice request by request: what is left after it, and each request after which a lower power of two is left, with the power before.

    A slice is one range partition, so its requests fit a task however many there are in all.
    """
    one = asks.filter((F.col(SLICE) == at) & (F.col("currency") == currency)).agg(
        F.sort_array(F.collect_list(F.struct("payout_id", "ask"))).alias("requests"))
    return one.select(F.expr(f"""aggregate(requests, named_struct('left', {left}L, 'ends', cast(array() as array<struct<payout_id: string, level: bigint>>)), (s, x) ->
        case when x.ask > s.left or x.ask = 0 then s else named_struct('left', s.left - x.ask, 'ends',
          case when s.left = x.ask or length(bin(s.left - x.ask)) < length(bin(s.left))
            then concat(s.ends, array(named_struct('payout_id', x.payout_id, 'level', shiftleft(1L, length(bin(s.left)) - 1)))) else s.ends end) end)""").alias("s")).first().s


def payout_cash_check(checks: DataFrame, balances: DataFrame) -> DataFrame:
    """Accepted requests take cash of their currency in payout order; one asking for more than is left is
    refused and takes nothing.

    While at least 2^j is left, every request below 2^j fits, and the first larger one that fits leaves less than 2^j.  So a slice of the
    sequence is known by two numbers per power (``_slice_facts``), and the slices follow one another by those numbers alone; only the
    slices in which a power is used up are gone through, and there are no more of those than powers.  All requests are read a few times: to
    slice them, for the facts of the slices (see ``POWERS``), and for the verdicts.  What reaches the driver is one row per slice and currency.
    """
    asks = checks.filter("verdict = 'ACCEPTED'").select("payout_id", "currency", F.col("total_net_minor").alias("ask"))
    cash = balances.filter("account_id = 'acct_platform_cash'").select("currency", "balance_minor").collect()
    asks = sliced(asks, ["currency"], ["payout_id"], "payout-asks")
    left = {r.currency: r.balance_minor for r in cash if r.balance_minor > 0}
    decided, done, spans = dict.fromkeys(left, ""), dict.fromkeys(left, -1), []
    walking = dict(left)
    while walking:
        powers = {c: left[c].bit_length() - 1 for c in walking}
        facts: dict[str, list] = {c: [] for c in walking}
        ahead = None
        for c in walking:
            rest_of = (F.col("currency") == c) & (F.col(SLICE) > done[c])
            ahead = rest_of if ahead is None else ahead | rest_of
        for r in _slice_facts(asks.filter(ahead), list(powers.items())).collect():
            facts[r.currency].append(r)
        for currency in list(walking):
            rest = left[currency]
            for slice_ in sorted(facts[currency], key=lambda r: r[SLICE]):
                k = powers[currency] - rest.bit_length() + 1
                if k >= POWERS:
                    break  # The facts of lower powers come with the next pass.
                level, need, below = 1 << rest.bit_length() - 1, slice_[f"need_{k}"], slice_[f"below_{k}"]
                if (need is None or need > rest) and rest - below >= level:
                    rest -= below
                else:
                    found = _through_slice(asks, currency, slice_[SLICE], rest)
                    for end in found.ends:
                        spans.append((currency, decided[currency], end.payout_id, end.level))
                        decided[currency] = end.payout_id
                    rest = found.left
                done[currency] = slice_[SLICE]
                if rest == 0:
                    break
            else:
                walking.pop(currency)  # No slice is left.
            left[currency] = rest
            if rest == 0:
                walking.pop(currency, None)
    # Every request up to the last is decided where something is left.
    spans += [(c, decided[c], None, 1 << rest.bit_length() - 1) for c, rest in left.items() if rest > 0]

    spans = dimension(asks.sparkSession, spans or [("-", "", "", 0)], "span_currency, after_id, end_id, level")
    inside = (F.col("currency") == F.col("span_currency")) & (F.col("payout_id") > F.col("after_id")) & (
        F.col("end_id").isNull() | (F.col("payout_id") <= F.col("end_id")))
    fits = F.expr("ask = 0 or coalesce(ask < level or payout_id = end_id, false)")
    return asks.join(F.broadcast(spans), inside, "left").select(
        "payout_id", "currency", F.col("ask").alias("total_net_minor"),
        F.when(fits, "EXECUTABLE").otherwise("INSUFFICIENT_CASH").alias("verdict"))


def payout_with_lines(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Payouts beside their lines, one row per line: a payout of any size stays distributed."""
    detail = lines.select(F.col("payout_record_id").alias("id"), "line_no", "payment_id", "line_net_minor")
    return records.select("id", "merchant_reference", "currency", "total_net_minor", "line_count", "status").join(detail, "id")


def merchant_payout_history(records: DataFrame, merchant: str | None = None) -> DataFrame:
    if merchant is not None:
        records = records.filter(F.col("merchant_reference") == merchant)
    return records.select("merchant_reference", "id", "currency", "total_net_minor", "line_count", "executed_at").orderBy(
        "merchant_reference", F.col("executed_at").desc(), "id")


def payable_payments(payments: DataFrame, paid_lines: DataFrame) -> DataFrame:
    return (
        payments.filter("state = 'SETTLED'").select("id", "merchant_reference", "currency", "net_amount_minor")
        .join(paid_lines.select(F.col("payment_id").alias("id")), "id", "left_anti")
    )
