"""Continuous versions of the ingestion jobs.

Every job reads a stream, transforms it with the same column expressions as its batch twin and writes a
table below the shared folder.  Stateless jobs append through the exactly-once file sink.  The others write what changed in
each micro-batch as a piece of its epoch (``tables.EpochTable``): a replayed batch overwrites its own piece, pieces are merged behind the stream, and
readers take the last epoch per key or merge the pieces' partial results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from settlespark import vocab
from settlespark.operators import ingest, payments as pay, settlement
from settlespark.operators.ledger import SIGNED
from settlespark.session import new_path
from settlespark.sources.scenario import deliveries_from_events
from settlespark.streaming.tables import EVERY, EpochTable

EVENT_KEY = ingest.EVENT_KEY


def streaming_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose state lives in RocksDB on the executors.

    Every shuffle partition keeps a state store open: as many as submitted, or ``partitions``.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder (or glob) of Parquet files as a stream, with the schema its files have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def delivery_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    return deliveries_from_events(read_stream(spark, path, files_per_batch))


def _places(spark: SparkSession, label: str, target: str | None) -> tuple[str, str]:
    """Table and progress folders: below ``target``, where a later run goes on, or new ones."""
    if target:
        return f"{target}/table", f"{target}/progress"
    return new_path(spark, label), new_path(spark, f"{label}-progress")


def run_append(stream: DataFrame, label: str, target: str | None = None) -> DataFrame:
    """Drain what is available into a table and return it.  With a ``target`` folder, a later run resumes where this one ended."""
    spark = stream.sparkSession
    out, progress = _places(spark, label, target)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_epochs(
    stream: DataFrame, label: str, mode: str, step: Callable[[DataFrame, int, str], DataFrame] | None = None, target: str | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None, every: int = EVERY,
) -> DataFrame:
    """Drain what is available, writing ``step(rows, epoch, folder)`` of each micro-batch as a piece; the rows come back with their ``epoch``.

    With a ``target`` folder, a later run goes on with the next epoch of the same table.  ``merge`` keeps the columns it is given.
    """
    spark = stream.sparkSession
    out, progress = _places(spark, label, target)
    table = EpochTable(spark, out, merge, every)

    def save(rows: DataFrame, epoch: int) -> None:
        table.compact(epoch)
        result = step(rows, epoch, out) if step else rows
        table.write(result.withColumn("epoch", F.lit(epoch)), epoch)

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", progress)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not table.pieces():
        # Nothing has arrived yet: an empty piece, so that readers find a table.
        save(spark.createDataFrame([], stream.schema), 0)
    return table.read(table.schema())


def last_epoch(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key, without its epoch."""
    return _newest(changes, keys).drop("epoch")


def _newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select(*keys, "last.*")


# ------------------------------------------------------------------ jobs


def genuine(deliveries: DataFrame, secret: str) -> DataFrame:
    return ingest.checked_deliveries(deliveries, secret).filter("rejection is null")


EVENT_DAY = "to_date(occurred_at)"


def run_copies(deliveries: DataFrame, secret: str, target: str | None = None, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(attempts, firsts): every delivery attempt with its row-local verdict, and the first copy of each event with its body.

    First means first by (received_at, id), as in the batch, in whatever order the copies come.  Nothing is kept in operator state.  What was
    seen before lies in ``firsts``; every copy of an event names the same day in its body, so a micro-batch is compared with the stored
    events of its own days only, however late it is, and no row is dropped for being late.  An event gets another row if an earlier copy
    turns up later; readers and merges keep the least.
    """
    spark = deliveries.sparkSession
    checked = ingest.checked_deliveries(deliveries, secret).withColumn("occurred_at", ingest.occurred_at("r.p"))
    rows = checked.select(
        "id", *EVENT_KEY, "received_at", "rejection", "signature_valid", F.when(F.col("rejection").isNull(), F.expr(EVENT_DAY)).alias("day"), "body")
    within = lambda name: f"{target}/{name}" if target else None
    attempts = EpochTable(spark, within("attempts") or new_path(spark, "attempts"), every=every)
    known = EpochTable(spark, within("firsts") or new_path(spark, "firsts"), _least_copy, every)

    def step(batch: DataFrame, epoch: int) -> None:
        attempts.compact(epoch)
        known.compact(epoch)
        stored = attempts.write(batch, epoch)
        firsts = _least_copy(stored.filter("rejection is null").select(*FIRST_COLUMNS))
        days = firsts.select("day").distinct()
        before = known.read(firsts.schema, before=epoch).join(F.broadcast(days), "day", "left_semi")
        earlier = before.groupBy(*EVENT_KEY).agg(F.min(F.struct("received_at", "id")).alias("seen"))
        new = firsts.join(earlier, EVENT_KEY, "left").filter("seen is null or struct(received_at, id) < seen")
        known.write(new.select(*FIRST_COLUMNS), epoch)

    progress = within("progress") or new_path(spark, "copies-progress")
    rows.writeStream.foreachBatch(step).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    if not attempts.pieces():
        step(spark.createDataFrame([], rows.schema), 0)
    return attempts.read(attempts.schema()), _least_copy(known.read(known.schema()))


FIRST_COLUMNS = [*EVENT_KEY, "day", "received_at", "id", "body"]


def _least_copy(copies: DataFrame) -> DataFrame:
    least = F.min_by(F.struct("day", "received_at", "id", "body"), F.struct("received_at", "id")).alias("least")
    return copies.groupBy(*EVENT_KEY).agg(least).select(*EVENT_KEY, "least.*").select(*FIRST_COLUMNS)


def run_dedupe_events(deliveries: DataFrame, secret: str, target: str | None = None) -> DataFrame:
    """One event per id: its first copy."""
    firsts = run_copies(deliveries, secret, target)[1]
    return firsts.select(*EVENT_KEY, F.col("id").alias("delivery_id"), "received_at", "body")


def run_classify_deliveries(deliveries: DataFrame, secret: str, target: str | None = None) -> DataFrame:
    """The outcome of every attempt.  The mark of the first copy is found by its own id, so an event redelivered without end is no large key."""
    attempts, firsts = run_copies(deliveries, secret, target)
    marked = attempts.join(firsts.select("id", F.lit(True).alias("first")), "id", "left")
    outcome = F.expr("case when rejection is not null then rejection when first then 'ACCEPTED' else 'DUPLICATE' end")
    return marked.withColumn("outcome", outcome).select(
        "id", *EVENT_KEY, "received_at", "outcome", F.expr(ingest.HTTP_STATUS).alias("http_status"), "signature_valid")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, told once: in the micro-batch that brings the key, by ``order`` among that batch's rows.

    For update mode.  The time of the micro-batch decides between batches; it is part of the progress record, so a replay sees the same.
    """
    rest = [c for c in rows.columns if c not in keys]
    timed = rows.withColumn("batch_at", F.current_timestamp())
    per = timed.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct("batch_at", *order)).alias("first"), F.min("batch_at").alias("since"), F.max("batch_at").alias("now"))
    return per.filter("since = now").select(*keys, "first.*")


def parsed(deliveries: DataFrame, secret: str) -> DataFrame:
    return ingest.parse_provider_events(genuine(deliveries, secret).withColumnRenamed("id", "delivery_id"))


def payment_events(deliveries: DataFrame, secret: str) -> DataFrame:
    return ingest.map_event_target_state(parsed(deliveries, secret)).filter("routing = 'PAYMENT'")


def run_provider_status(deliveries: DataFrame, secret: str, target: str | None = None, every: int = EVERY) -> DataFrame:
    """Each micro-batch leaves its partial result; merging them is order-free, for readers as for the pieces.
    Redeliveries are dropped first: a late copy of an old claim must not pass for the latest."""
    once = first_seen(payment_events(deliveries, secret), EVENT_KEY, ["received_at", "delivery_id"])

    def merged(partials: DataFrame) -> DataFrame:
        return pay.combine_provider_status(partials).withColumn("epoch", F.lit(-1))

    partials = run_epochs(once, "provider-status", "update", lambda rows, epoch, out: pay.provider_status_partials(rows), target, merged, every)
    return pay.merge_provider_status(partials.drop("epoch"))


def settled_marks(marks: DataFrame, settlements: DataFrame, payments: DataFrame) -> DataFrame:
    """``s``: the first valid settlement of each known payment that takes effect.

    A record takes effect as a whole, once every payment of ours that it covers is captured; until then none of them settles.  Whether
    a record is blocked is one aggregate per record, so a record of any size is never gathered.
    """
    key = ["provider", "provider_transaction_id"]
    lines = settlements.filter("validity = 'VALID'").select(
        "id", "provider", F.struct("received_at", "delivery_id").alias("seq"), F.explode("lines.providerTransactionId").alias("provider_transaction_id"))
    ours = payments.select(*key).distinct()
    captured = F.expr("c is not null and (f is null or c < f)")
    covered = lines.join(ours, key).join(marks.select(*key, captured.alias("captured")), key, "left")
    open_records = covered.groupBy("id").agg(F.min(F.coalesce("captured", F.lit(False))).alias("ready")).filter("ready").select("id")
    return covered.join(open_records, "id").groupBy(*key).agg(F.min("seq").alias("s"))


TXN = ["provider", "provider_transaction_id"]


def payment_news(deliveries: DataFrame, secret: str) -> DataFrame:
    """State by (kind, provider, key), one row for each that changed: transactions (kind T) with the first arrival of each kind of news about
    them and the settlements that name them, and settlements (kind S) with the first report of each.

    Minimums and sets do not care about the order or the number of deliveries.  A delivery is read and parsed once and feeds both kinds.
    """
    routed = ingest.map_event_target_state(parsed(deliveries, secret)).filter(
        "routing = 'PAYMENT' or (routing = 'SETTLEMENT' and settlement.providerSettlementId is not null)")
    none = "cast(null as string)"
    news = F.expr(f"""case when routing = 'PAYMENT' then
          array(named_struct('kind', 'T', 'key', provider_transaction_id, 'target', target_state, 'sid', {none}))
        else concat(array(named_struct('kind', 'S', 'key', settlement.providerSettlementId, 'target', {none}, 'sid', {none})),
          transform(array_distinct(filter(settlement.lines.providerTransactionId, t -> t is not null)), t ->
            named_struct('kind', 'T', 'key', t, 'target', {none}, 'sid', settlement.providerSettlementId))) end""")
    rows = routed.select("provider", "received_at", "delivery_id", "settlement", F.current_timestamp().alias("batch_at"), F.explode(news).alias("n"))
    seq = F.struct("received_at", "delivery_id")

    def first(target: str, name: str):
        return F.min(F.when(F.col("n.target") == target, seq)).alias(name)

    report = F.when(F.col("n.kind") == "S", F.struct("settlement", "received_at", "delivery_id"))
    return rows.groupBy(F.col("n.kind").alias("kind"), "provider", F.col("n.key").alias("key")).agg(
        first("CREATED", "n"), first("AUTHORIZED", "a"), first("CAPTURED", "c"), first("FAILED", "f"), first("REFUNDED", "r"), F.collect_set("n.sid").alias("sids"),
        F.min_by(report, F.struct("batch_at", "received_at", "delivery_id")).alias("report"), F.min("batch_at").alias("since"), F.max("batch_at").alias("now"))


CAPTURED = "c is not null and (f is null or c < f)"


def run_payment_state(
    deliveries: DataFrame, secret: str, payments: DataFrame, target: str | None = None, every: int = EVERY, max_deferrals: int = vocab.MAX_DEFERRALS
) -> tuple[DataFrame, DataFrame]:
    """(states, settlements): the state of each known payment that anything was heard of, and how each settlement stands.

    Direct events count as they came.  A settlement is judged once, by all nine rules, when it is first heard of; a valid one takes effect as a
    whole record, as soon as every payment of ours that it covers is captured.  Until then it waits: each micro-batch is one more pass over what
    waits, and one that has been passed over ``max_deferrals`` times is DEAD and never takes effect.  Events of unknown payments stay in
    the state until the payment is known.

    One query: the state of ``payment_news``, its changes in a table, new settlements with their verdicts in a second, and in a third what
    waits after each epoch.  A pass costs as much as waits and has changed, not as much as was ever seen.
    """
    spark = deliveries.sparkSession
    base, progress = _places(spark, "payment-state", target)
    changes = EpochTable(spark, f"{base}/changes", lambda rows: _newest(rows, ["kind", "provider", "key"]), every)
    records = EpochTable(spark, f"{base}/records", every=every)
    waiting = EpochTable(spark, f"{base}/waiting")
    ended = EpochTable(spark, f"{base}/ended", every=every)
    ours = payments.select(*TXN).distinct()

    def save(rows: DataFrame, epoch: int) -> None:
        for table in (changes, records, ended):
            table.compact(epoch)
        changed = changes.write(rows.withColumn("epoch", F.lit(epoch)), epoch)
        new = changed.filter("kind = 'S' and since = now").select("provider", "report.*")
        judged = records.write(judged_settlements(new, payments), epoch)
        lines = judged.filter("validity = 'VALID'").select(
            "provider", F.col("provider_settlement_id").alias("sid"), F.explode(F.array_distinct("lines.providerTransactionId")).alias("provider_transaction_id"))
        fresh = lines.join(ours, TXN).select("provider", "sid", "provider_transaction_id", F.lit(0).alias("deferrals"))
        left = waiting.read_epoch(fresh.schema, epoch - 1).unionByName(fresh)
        done = changed.filter(f"kind = 'T' and {CAPTURED}").select("provider", F.explode("sids").alias("sid"), F.col("key").alias("provider_transaction_id"))
        left = left.join(done, ["provider", "sid", "provider_transaction_id"], "left_anti").withColumn("deferrals", F.col("deferrals") + 1)
        dead = left.filter(F.col("deferrals") >= max_deferrals)
        ended.write(dead.select("provider", "sid", "deferrals").distinct(), epoch)
        # What waits is told whole in each epoch; the piece of the epoch before is enough to go on from, also if this one is replayed.
        waiting.write(left.filter(F.col("deferrals") < max_deferrals), epoch)
        waiting.keep_from(epoch - 1)

    news = payment_news(deliveries, secret)
    news.writeStream.foreachBatch(save).option("checkpointLocation", progress).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    if not changes.pieces():
        save(spark.createDataFrame([], news.schema), 0)

    marks = last_epoch(changes.read(changes.schema()).filter("kind = 'T'"), ["kind", "provider", "key"]).withColumnRenamed("key", "provider_transaction_id")
    heard = marks.filter("coalesce(n, a, c, f, r) is not null")
    still = waiting.read_epoch(waiting.schema(), waiting.pieces()[-1][1])
    dead = ended.read(ended.schema())
    valid = records.read(records.schema())
    alive = valid.join(dead.select("provider", F.col("sid").alias("provider_settlement_id")), ["provider", "provider_settlement_id"], "left_anti")
    every_mark = heard.join(settled_marks(marks, alive, payments), TXN, "left").join(ours, TXN)
    states = pay.final_states(every_mark).select(*TXN, "state")

    passed = still.groupBy("provider", "sid").agg(F.max("deferrals").alias("deferrals")).withColumn("status", F.lit("WAITING"))
    passed = passed.unionByName(dead.withColumn("status", F.lit("DEAD"))).withColumnRenamed("sid", "provider_settlement_id")
    settlements = valid.join(passed, ["provider", "provider_settlement_id"], "left").select(
        "provider", "provider_settlement_id", "validity", "rule", F.expr("coalesce(status, case when validity = 'VALID' then 'PROCESSED' else 'REFUSED' end)").alias("status"),
        F.coalesce("deferrals", F.lit(0)).alias("deferrals"))
    return states, settlements


def run_balances(entries: DataFrame, accounts: DataFrame, target: str | None = None, every: int = EVERY) -> DataFrame:
    """Running balance per account and currency; the few groups are combined per task before the state is touched."""
    sides = accounts.select(F.col("id").alias("account_id"), "normal_side")
    live = entries.join(sides, "account_id").groupBy("account_id", "currency").agg(
        F.sum(F.expr(SIGNED)).alias("balance_minor"), F.count(F.lit(1)).alias("entry_count"))
    keys = ["account_id", "currency"]
    return last_epoch(run_epochs(live, "balances", "update", target=target, merge=lambda rows: _newest(rows, keys), every=every), keys)


def judged_settlements(reports: DataFrame, payments: DataFrame) -> DataFrame:
    """``reports`` (provider, settlement, received_at, delivery_id) as records, header and lines, with their verdict."""
    new = reports.select(
        F.concat("provider", F.lit(":"), "settlement.providerSettlementId").alias("id"),
        F.col("settlement.providerSettlementId").alias("provider_settlement_id"), "provider", "delivery_id", "received_at",
        F.expr("try_cast(settlement.settlementDate as date)").alias("settlement_date"), F.col("settlement.currency").alias("currency"),
        F.col("settlement.grossAmountMinor").alias("gross_amount_minor"), F.col("settlement.feeAmountMinor").alias("fee_amount_minor"),
        F.col("settlement.netAmountMinor").alias("net_amount_minor"), "settlement.lines")
    lines = new.select(F.col("id").alias("settlement_record_id"), F.posexplode("lines").alias("pos", "l")).select(
        "settlement_record_id", F.col("l.providerTransactionId").alias("provider_transaction_id"), F.col("l.grossAmountMinor").alias("line_gross_minor"),
        F.col("l.netAmountMinor").alias("line_net_minor"), F.expr("pos + 1").alias("line_no"))
    verdicts = settlement.validate_settlements(new.drop("lines"), lines, payments).select("id", "validity", "rule")
    return new.join(verdicts, "id")


def run_settlements(deliveries: DataFrame, secret: str, payments: DataFrame, target: str | None = None, every: int = EVERY) -> DataFrame:
    """Insert-if-absent settlement records, header and lines, with a verdict judged once, at first arrival.

    Which settlements were seen is streaming state by (provider, settlement id), so no stored epoch is read again.
    """
    reports = parsed(deliveries, secret).filter("event_type = 'settlement.paid' and settlement is not null").select(
        "provider", F.col("settlement.providerSettlementId").alias("settlement_id"), "delivery_id", "received_at", "settlement")
    new = first_seen(reports, ["provider", "settlement_id"], ["received_at", "delivery_id"]).drop("settlement_id")
    step = lambda rows, epoch, out: judged_settlements(rows, payments)
    return run_epochs(new, "settlements", "update", step, target, every=every).drop("epoch")


def stream_dead_letters(deliveries: DataFrame, secret: str) -> DataFrame:
    """Signed and fresh deliveries that can never have an effect."""
    checked = ingest.checked_deliveries(deliveries, secret).filter("rejection is null or (rejection = 'REJECTED_MALFORMED' and signature_valid)")
    routed = ingest.map_event_target_state(ingest.parse_provider_events(checked))
    reason = F.expr("""case when reject_reason is not null then 'MALFORMED' when routing like 'DEAD%' then substring(routing, 6)
        when routing = 'SETTLEMENT' and settlement is null then 'NO_SETTLEMENT' end""")
    return routed.withColumn("reason", reason).filter("reason is not null").select("id", *EVENT_KEY, "event_type", "reason")
