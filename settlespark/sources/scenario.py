"""Domain tables derived from the given order and event tables by row-local rules.

Payments, provider rows and settlements come from ``orders``; deliveries, event payments and the
command log come from ``events``.  Every rule is a function of the row's own key, so the tables grow
with the input and stay distributed.  The rules plant the defects the operators look for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from settlespark.functions.crypto import hmac_sha256
from settlespark.functions.money import half_up_fee, minor_units
from settlespark.operators import postings, settlement
from settlespark.session import ROW_GROUP, write_new
from settlespark import vocab

WEBHOOK_SECRET = "whsec_scenario"
NOW_ORDERS = "2002-01-01 00:00:00"
NOW_EVENTS = "2024-02-01 00:00:00"
WINDOW = ("1995-01-01 00:00:00", "2002-01-01 00:00:00")
WINDOW_A = ("1995-01-01 00:00:00", "1999-01-01 00:00:00")
WINDOW_B = ("1998-01-01 00:00:00", "2002-01-01 00:00:00")
RETENTION_DAYS = 7


# (application, input folder, table) → (path, schema)
_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class stored(cached_property):
    """A domain table: derived once per application and input folder, written to the shared folder as
    parquet, and scanned from there by every operator, with pruning and pushdown."""

    def __init__(self, build: Callable[[Scenario], DataFrame]):
        super().__init__(lambda self: self.keep(build.__name__, lambda: build(self)))
        self.__doc__ = build.__doc__


class Scenario:
    """Domain tables are derived on first use; the rest are lazy DataFrames over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            df = build()
            _stored[key] = (write_new(df, name, **{"parquet.block.size": ROW_GROUP}), df.schema)
        path, schema = _stored[key]
        return self.spark.read.schema(schema).parquet(path)

    def path_of(self, name: str) -> str:
        """Folder of a stored table, for reading it as a stream."""
        made = getattr(self, name)
        self.keep(name, lambda: made)
        return _stored[(self.spark.sparkContext.applicationId, self.sf_dir, name)][0]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ payments

    @stored
    def payments(self) -> DataFrame:
        o = self.table("orders").select(
            F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cu"),
            minor_units("o_totalprice").alias("amount_minor"), F.col("o_orderdate").alias("created_at"),
        )
        o = o.withColumn("currency", F.expr("element_at(array('EGP','USD','EUR','GBP'), cast(cu % 4 as int) + 1)"))
        o = o.withColumn("bps", F.expr("case when currency = 'USD' then 250 else 300 end"))
        o = o.withColumn("platform_fee_minor", half_up_fee("amount_minor", "bps"))
        o = o.withColumn("p", F.expr("case when k % 97 = 5 then k - 1 else k end"))
        o = o.withColumn("provider", F.expr("case when p % 5 = 4 then 'PSP_B' else 'SIMULATED_PSP' end"))
        o = o.withColumn("provider_transaction_id", F.expr("case when k % 41 <> 0 then concat('psp_', p) end"))
        o = o.withColumn("state", F.expr(
            "case k % 20 when 0 then 'FAILED' when 1 then 'CREATED' when 2 then 'AUTHORIZED' "
            "when 3 then 'REFUNDED' when 4 then 'REFUNDED' when 5 then 'CAPTURED' when 6 then 'CAPTURED' "
            "when 7 then 'CAPTURED' else 'SETTLED' end"))
        o = o.withColumn("captured_at", F.expr("case when k % 20 >= 3 then created_at + make_dt_interval(0, k % 24) end"))
        o = o.withColumn("settled", F.expr("k % 20 = 4 or k % 20 >= 8"))
        o = o.withColumn("ym", F.expr("cast(year(captured_at) * 100 + month(captured_at) as bigint)"))
        return o.select(
            F.expr("concat('pay_', k)").alias("id"), "k", "cu",
            F.expr("concat('MERCH-', cu)").alias("merchant_reference"),
            "amount_minor", "currency", "platform_fee_minor",
            F.expr("amount_minor - platform_fee_minor").alias("net_amount_minor"),
            F.expr("case when currency = 'USD' then 'fp_usd' else 'fp_default' end").alias("fee_policy_id"),
            "state", F.expr("case when state = 'FAILED' then 'CARD_DECLINED' end").alias("failure_code"),
            "provider", "provider_transaction_id",
            F.expr("case when settled and provider_transaction_id is not null "
                   "then concat('srec_', provider, '_', currency, '_', ym) end").alias("settlement_record_id"),
            "captured_at",
            F.expr("case when settled then cast(date_add(last_day(captured_at), 1) as timestamp_ntz) end").alias("settled_at"),
            F.expr("case when k % 20 >= 8 and k % 3 = 0 then timestamp_ntz'2001-12-01 00:00:00' end").alias("paid_out_at"),
            F.expr("created_at + interval 7 days").alias("expires_at"), "created_at",
        )

    @cached_property
    def fee_policies(self) -> DataFrame:
        return vocab.dimension(self.spark, [
            ("fp_default", "DEFAULT", 300, "EGP", True),
            ("fp_usd", "USD_STANDARD", 250, "USD", True),
            ("fp_gbp", "GBP_RETIRED", 200, "GBP", False),
        ], "id, code, bps, currency, active")

    # ------------------------------------------------------------------ settlement statements

    @stored
    def _covered(self) -> DataFrame:
        """Settled payments with an id, each knowing its record, the record's planted defect ``v``
        and whether it is the record's first line."""
        p = (
            self.payments.filter("settlement_record_id is not null")
            .select("k", "settlement_record_id", "provider", "currency", "provider_transaction_id",
                    "amount_minor", "platform_fee_minor", "net_amount_minor", "captured_at")
            .withColumn("v", F.expr("(year(captured_at) * 12 + month(captured_at)) % 24"))
        )
        first = (
            p.filter("v in (4, 5)").groupBy("settlement_record_id").agg(F.min("k").alias("k"))
            .select("k", F.lit(True).alias("first_line"))
        )
        return p.join(first, "k", "left").withColumn("first_line", F.coalesce("first_line", F.lit(False)))

    @cached_property
    def _orphans(self) -> DataFrame:
        return self.payments.filter("k % 53 = 7")

    @stored
    def statements(self) -> DataFrame:
        """Settlement records as the provider sent them (no verdict yet)."""
        totals = (
            self._covered.groupBy("settlement_record_id", "provider", "currency", "v")
            .agg(F.sum("amount_minor").alias("g"), F.sum("platform_fee_minor").alias("f"),
                 F.sum("net_amount_minor").alias("n"), F.min(F.last_day("captured_at")).alias("day"))
        )
        months = totals.select(
            F.col("settlement_record_id").alias("id"), "provider",
            F.expr("concat('set_', substring(settlement_record_id, 6))").alias("provider_settlement_id"),
            F.expr("case v when 1 then g + 100 when 6 then -1 else g end").alias("gross_amount_minor"),
            F.expr("case v when 1 then f + 100 when 2 then f + 100 when 3 then f + 1 else f end").alias("fee_amount_minor"),
            F.expr("case v when 2 then n - 100 else n end").alias("net_amount_minor"),
            F.expr("case when v = 7 then 'JPY' when v <> 8 then currency when currency = 'EGP' then 'USD' else 'EGP' end").alias("currency"),
            F.col("day").alias("settlement_date"), "v",
        )
        reissued = months.filter("v = 10").select(
            F.expr("concat('srec2_', substring(id, 6))").alias("id"), "provider",
            F.expr("concat('set2_', substring(id, 6))").alias("provider_settlement_id"),
            "gross_amount_minor", "fee_amount_minor", "net_amount_minor", "currency",
            F.date_add("settlement_date", 3).alias("settlement_date"), "v",
        )
        lone = self._orphans.filter("k % 4 = 0").select(
            F.expr("concat('srec_o', k)").alias("id"), "provider", F.expr("concat('set_o', k)").alias("provider_settlement_id"),
            F.col("amount_minor").alias("gross_amount_minor"), F.col("platform_fee_minor").alias("fee_amount_minor"),
            F.col("net_amount_minor"), "currency", F.expr("cast(created_at as date)").alias("settlement_date"),
            F.lit(0).alias("v"),
        )
        return months.unionByName(reissued).unionByName(lone).drop("v")

    @stored
    def statement_lines(self) -> DataFrame:
        """``line_no`` follows the order key: sparse, unique and increasing inside a record."""
        copies = F.expr(
            "case when v = 9 then array() "
            "when v = 4 and first_line then array(named_struct('id', settlement_record_id, 'no', 2 * k), "
            "named_struct('id', settlement_record_id, 'no', 2 * k + 1)) "
            "when v = 10 then array(named_struct('id', settlement_record_id, 'no', 2 * k), "
            "named_struct('id', concat('srec2_', substring(settlement_record_id, 6)), 'no', 2 * k)) "
            "else array(named_struct('id', settlement_record_id, 'no', 2 * k)) end")
        lines = self._covered.withColumn("copy", F.explode(copies)).select(
            F.col("copy.id").alias("settlement_record_id"), "provider_transaction_id",
            F.col("amount_minor").alias("line_gross_minor"),
            F.expr("case when v = 5 and first_line then amount_minor + 1 else net_amount_minor end").alias("line_net_minor"),
            F.col("copy.no").alias("line_no"),
        )
        lone = self._orphans.filter("k % 4 = 0").select(
            F.expr("concat('srec_o', k)").alias("settlement_record_id"),
            F.expr("concat('psp_orphan_', k)").alias("provider_transaction_id"),
            F.col("amount_minor").alias("line_gross_minor"), F.col("net_amount_minor").alias("line_net_minor"),
            F.expr("2 * k").alias("line_no"),
        )
        return lines.unionByName(lone)

    @stored
    def settlement_records(self) -> DataFrame:
        """Statements with their verdict."""
        verdicts = settlement.validate_settlements(self.statements, self.statement_lines, self.payments)
        return self.statements.join(verdicts.select("id", "validity", "validity_reason"), "id")

    # ------------------------------------------------------------------ provider rows

    @stored
    def provider_transactions(self) -> DataFrame:
        p = self.payments.filter(
            "provider_transaction_id is not null and k % 97 <> 5 and (k % 20 >= 3 or k % 40 = 0) and k % 29 <> 0")
        rows = p.withColumn("copy", F.explode(F.expr("sequence(1, case when k % 29 = 6 then 2 else 1 end)"))).select(
            F.expr("concat('ptx_', k, case when copy = 2 then '_b' else '' end)").alias("id"),
            "provider", "provider_transaction_id", F.col("id").alias("payment_id"),
            F.expr("case when k % 29 = 5 then 'MERCH-OTHER' else merchant_reference end").alias("merchant_reference"),
            F.expr("case when k % 29 = 1 then amount_minor - 300 else amount_minor end").alias("gross_amount_minor"),
            F.expr("case when k % 29 = 2 then platform_fee_minor + 300 else platform_fee_minor end").alias("fee_amount_minor"),
            F.expr("case when k % 29 in (1, 2) then net_amount_minor - 300 else net_amount_minor end").alias("net_amount_minor"),
            F.expr("case when k % 29 <> 3 then currency when currency = 'EGP' then 'USD' else 'EGP' end").alias("currency"),
            F.expr("case when k % 29 = 4 then 'CAPTURED' when k % 20 in (3, 4) then 'REFUNDED' "
                   "when k % 20 >= 8 then 'SETTLED' else 'CAPTURED' end").alias("provider_status"),
            F.lit("WEBHOOK").alias("source"), F.expr("coalesce(captured_at, created_at)").alias("captured_at"),
        )
        orphans = self._orphans.select(
            F.expr("concat('ptx_o', k)").alias("id"), "provider",
            F.expr("concat('psp_orphan_', k)").alias("provider_transaction_id"),
            F.lit(None).cast("string").alias("payment_id"), F.lit("UNKNOWN").alias("merchant_reference"),
            F.col("amount_minor").alias("gross_amount_minor"), F.col("platform_fee_minor").alias("fee_amount_minor"),
            F.col("net_amount_minor"), "currency", F.lit("SETTLED").alias("provider_status"),
            F.lit("WEBHOOK").alias("source"), F.expr("case when k % 2 = 1 then created_at end").alias("captured_at"),
        )
        return rows.unionByName(orphans)

    # ------------------------------------------------------------------ ledger

    @cached_property
    def captured(self) -> DataFrame:
        return self.payments.filter("captured_at is not null")

    @cached_property
    def capture_postings(self) -> DataFrame:
        return postings.post_captures(self.captured)

    @cached_property
    def reversal_postings(self) -> DataFrame:
        refunded = self.payments.filter("k % 20 = 3").select(
            F.concat(F.lit("ltx_cap_"), "id").alias("transaction_id"),
            F.concat(F.lit("refund of "), "id", F.lit(" before settlement")).alias("reason"),
            F.expr("captured_at + interval 1 day").alias("posted_at"),
        )
        return postings.post_reversals(self.capture_postings, refunded)

    @cached_property
    def refund_postings(self) -> DataFrame:
        refunded = self.payments.filter("k % 20 = 4").withColumn("refunded_at", F.expr("captured_at + interval 40 days"))
        return postings.post_refunds_after_settlement(refunded)

    @cached_property
    def settlement_postings(self) -> DataFrame:
        return postings.post_settlements(self.settlement_records, self.payments)

    @stored
    def payout_lines(self) -> DataFrame:
        return self.payments.filter("paid_out_at is not null").select(
            F.expr("concat('po_', cu, '_', currency)").alias("payout_record_id"), F.col("id").alias("payment_id"),
            F.col("net_amount_minor").alias("line_net_minor"), F.expr("k + 1").alias("line_no"),
            "merchant_reference", "currency", "paid_out_at",
        )

    @stored
    def payout_records(self) -> DataFrame:
        return self.payout_lines.groupBy("payout_record_id", "merchant_reference", "currency").agg(
            F.sum("line_net_minor").alias("total_net_minor"), F.count(F.lit(1)).alias("line_count"),
            F.min("paid_out_at").alias("executed_at"),
        ).select(
            F.col("payout_record_id").alias("id"), "merchant_reference", "currency", "total_net_minor", "line_count",
            F.lit("EXECUTED").alias("status"), F.concat(F.lit("ltx_po_"), "payout_record_id").alias("ledger_transaction_id"),
            "executed_at",
        )

    @cached_property
    def payout_postings(self) -> DataFrame:
        return postings.post_payouts(self.payout_records)

    @stored
    def all_postings(self) -> DataFrame:
        """Headers with their legs; both ledger tables are projections of this one table."""
        out = self.capture_postings
        for more in (self.reversal_postings, self.refund_postings, self.settlement_postings, self.payout_postings):
            out = out.unionByName(more)
        return out

    @cached_property
    def ledger_transactions(self) -> DataFrame:
        return postings.headers(self.all_postings)

    @cached_property
    def ledger_entries(self) -> DataFrame:
        return postings.entries(self.all_postings)

    @stored
    def ledger_links(self) -> DataFrame:
        return postings.link_payment_postings(
            self.capture_postings, self.refund_postings, self.reversal_postings)

    @cached_property
    def accounts(self) -> DataFrame:
        return vocab.ledger_accounts(self.spark)

    # ------------------------------------------------------------------ state history

    @stored
    def state_history(self) -> DataFrame:
        """Five possible rows per payment; some rows are dropped or bent to break the chain."""
        step = F.explode(F.expr("""filter(array(
            case when k % 107 <> 11 then named_struct('n', 1, 'f', cast(null as string), 't', 'CREATED', 'at', created_at, 'by', 'API') end,
            case when k % 20 = 0 then named_struct('n', 2, 'f', 'CREATED', 't', 'FAILED', 'at', created_at + interval 2 hours, 'by', 'WEBHOOK')
                 when k % 20 >= 2 and k % 101 <> 7 then named_struct('n', 2, 'f', 'CREATED', 't', 'AUTHORIZED', 'at', created_at, 'by', 'API') end,
            case when k % 20 >= 3 then named_struct('n', 3, 'f', case when k % 103 = 9 then 'CREATED' else 'AUTHORIZED' end, 't', 'CAPTURED', 'at', captured_at, 'by', 'WEBHOOK') end,
            case when settled_at is not null then named_struct('n', 4, 'f', 'CAPTURED', 't', 'SETTLED', 'at', settled_at, 'by', 'SETTLEMENT') end,
            case when k % 20 = 3 then named_struct('n', 5, 'f', 'CAPTURED', 't', 'REFUNDED', 'at', captured_at + interval 1 day, 'by', 'API')
                 when k % 20 = 4 then named_struct('n', 5, 'f', 'SETTLED', 't', 'REFUNDED', 'at', captured_at + interval 40 days, 'by', 'API') end
            ), x -> x is not null)"""))
        return self.payments.withColumn("s", step).select(
            F.expr("concat('psh_', k, '_', s.n)").alias("id"), F.col("id").alias("payment_id"),
            F.col("s.f").alias("from_state"), F.col("s.t").alias("to_state"), F.col("s.by").alias("trigger_type"),
            F.expr("concat('req_', k, '_', s.n)").alias("trigger_ref"), F.col("s.at").alias("occurred_at"),
        )

    # ------------------------------------------------------------------ deliveries and events

    @stored
    def deliveries(self) -> DataFrame:
        return deliveries_from_events(self.table("events"))

    @stored
    def event_payments(self) -> DataFrame:
        """One payment per transaction id seen in the events, except every thirteenth id."""
        x = self.table("events").select(
            F.expr("user_id * 20 + event_id % 20").alias("x"),
            F.expr("element_at(array('EGP','USD','EUR','GBP'), cast(user_id % 4 as int) + 1)").alias("currency"),
        ).filter("x % 13 <> 0").distinct()
        return x.select(
            F.expr("concat('pay_e', x)").alias("id"), F.lit("SIMULATED_PSP").alias("provider"),
            F.expr("concat('psp_e', x)").alias("provider_transaction_id"), F.lit("CREATED").alias("state"), "currency",
        )

    @stored
    def command_log(self) -> DataFrame:
        return self.table("events").select(
            F.expr("concat('cmd_', event_id)").alias("id"),
            F.expr("case when event_id % 2 = 0 then 'POST /payments' else 'POST /payouts' end").alias("endpoint"),
            F.expr("concat('key_', user_id, '_', event_id % 5)").alias("idem_key"),
            F.expr("case when event_id % 3 = 0 then 'POST' else 'PUT' end").alias("method"),
            F.expr("concat('/v1/resource/', event_id % 2)").alias("path_template"),
            F.expr("concat('{\"amount\":', event_id % 4, '}')").alias("body"),
            F.expr("concat('fp_', event_id % 4)").alias("fingerprint"), "ts",
            F.expr("event_id % 4 <> 1").alias("completed"),
            F.expr(f"ts + interval {RETENTION_DAYS} days").alias("expires_at"),
        )


def deliveries_from_events(events: DataFrame) -> DataFrame:
    """Delivery attempts; row-local, so it serves the stream as well as the batch."""
    d = events.select("event_id", "ts", "user_id", "event_type", "value").withColumn(
        "n", F.explode(F.expr("sequence(1, 1 + case when event_id % 10 = 0 then 1 else 0 end + case when event_id % 100 = 0 then 1 else 0 end)")))
    d = d.withColumn("e", F.col("event_id"))
    d = d.withColumn("type", F.expr(
        "case when e % 59 = 0 then 'payment.disputed' when e % 7 = 0 then 'settlement.paid' when e % 11 = 0 then 'payment.refunded' "
        "when event_type = 'signup' then 'payment.created' when event_type = 'view' then 'payment.authorized' "
        "when event_type = 'error' then 'payment.failed' else 'payment.captured' end"))
    d = d.withColumn("m", minor_units("value"))
    d = d.withColumn("fee", F.expr("cast((m * 300 + 5000) div 10000 as bigint)"))
    d = d.withColumn("net", F.expr("m - fee"))
    d = d.withColumn("ccy", F.expr("element_at(array('EGP','USD','EUR','GBP'), cast(user_id % 4 as int) + 1)"))
    d = d.withColumn("x1", F.expr("concat('psp_e', user_id * 20 + e % 20)"))
    d = d.withColumn("x2", F.expr("concat('psp_e', user_id * 20 + (e + 3) % 20)"))
    d = d.withColumn("occurred", F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    d = d.withColumn("settlement", F.expr(
        "concat('{\"providerSettlementId\":\"setl_', e, '\",\"settlementDate\":\"', date_format(ts, 'yyyy-MM-dd'), '\",\"currency\":\"', ccy, "
        "'\",\"grossAmountMinor\":', 2 * m + 100 + case when e % 5 = 0 then 50 else 0 end, ',\"feeAmountMinor\":', 2 * fee, "
        "',\"netAmountMinor\":', 2 * net + 100, ',\"lines\":[{\"providerTransactionId\":\"', x1, '\",\"grossAmountMinor\":', m, "
        "',\"netAmountMinor\":', net, '},{\"providerTransactionId\":\"', x2, '\",\"grossAmountMinor\":', m + 100, "
        "',\"netAmountMinor\":', net + 100, '}]}')"))
    d = d.withColumn("payment", F.expr(
        "concat(case when e % 71 = 0 then '' else concat(',\"providerTransactionId\":\"', x1, '\"') end, "
        "case when e % 9 = 0 then '' else concat(',\"merchantReference\":\"MERCH-', user_id, '\"') end, "
        "case when e % 13 = 0 then '' else concat(',\"gross\":{\"amountMinor\":', m, ',\"currency\":\"', ccy, '\"}', "
        "case when e % 6 = 0 then '' else concat(',\"fee\":{\"amountMinor\":', fee, ',\"currency\":\"', ccy, '\"}') end, "
        "',\"net\":{\"amountMinor\":', net, ',\"currency\":\"', ccy, '\"}') end, "
        "case type when 'payment.authorized' then ',\"status\":\"AUTHORIZED\"' when 'payment.captured' then ',\"status\":\"CAPTURED\"' "
        "when 'payment.refunded' then ',\"status\":\"REFUNDED\"' when 'payment.failed' then ',\"status\":\"FAILED\"' else '' end)"))
    d = d.withColumn("body", F.expr(
        "case when e % 47 = 0 then '{\"type\":' else concat('{\"type\":\"', type, '\",\"occurredAt\":\"', occurred, '\"', "
        "case when type = 'settlement.paid' then concat(',\"settlement\":', settlement) else payment end, '}') end"))
    d = d.withColumn("received_at", F.expr("date_trunc('second', ts) + make_dt_interval(0, (e * 7919 + n * 13) % 480)"))
    d = d.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    d = d.withColumn("age", F.expr("case when e % 37 = 0 then 600 when e % 38 = 0 then 300 else (e * 7919 + n) % 120 end"))
    d = d.withColumn("header_timestamp", F.expr(
        "cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', received_at) - age as string)"))
    d = d.withColumn("header_event_id", F.expr("case when e % 53 <> 0 then concat('evt_', e) end"))
    signed = hmac_sha256(WEBHOOK_SECRET, F.concat("header_timestamp", F.lit("."), "header_event_id", F.lit("."), "body"))
    return d.select(
        F.expr("concat('del_', e, '_', n)").alias("id"), F.lit("SIMULATED_PSP").alias("provider"),
        F.col("header_event_id").alias("event_id"), "body", F.col("header_timestamp").alias("timestamp"),
        F.when(F.expr("e % 43 = 0"), F.lit("00ff")).otherwise(F.upper(signed)).alias("signature"),
        "received_at", F.expr("case when e % 61 = 0 then 300000 else octet_length(body) end").alias("body_bytes"),
        F.expr("concat('req_', e, '_', n)").alias("request_id"),
    )
