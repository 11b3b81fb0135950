"""Event deliveries, settlement reports and command logs: parse, verify, classify, deduplicate, insert if absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from settlespark import vocab
from settlespark.functions.crypto import hmac_sha256, sha256_text
from settlespark.functions.keyed import first_per_key, mark_first
from settlespark.functions.once import once
from settlespark.functions.ordered import running_sums
from settlespark.session import remove, written

_MONEY = "struct<amountMinor bigint, currency string>"
_SETTLEMENT = ("struct<providerSettlementId string, settlementDate string, currency string, grossAmountMinor bigint, feeAmountMinor bigint, "
               "netAmountMinor bigint, lines array<struct<providerTransactionId string, grossAmountMinor bigint, netAmountMinor bigint>>>")
PAYLOAD = (f"type string, occurredAt string, providerTransactionId string, merchantReference string, gross {_MONEY}, fee {_MONEY}, net {_MONEY}, "
           f"status string, settlement {_SETTLEMENT}, _corrupt string")
PAYLOAD_KEYS = ["type", "occurredAt", "providerTransactionId", "merchantReference", "gross", "fee", "net", "status", "settlement"]
EVENT_KEY = ["provider", "event_id"]


def parsed_body(body: str = "body") -> Column:
    return F.from_json(F.col(body), PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


# The fields of the objects inside a body.
MONEY_KEYS = ["amountMinor", "currency"]
SETTLEMENT_KEYS = ["providerSettlementId", "settlementDate", "currency", "grossAmountMinor", "feeAmountMinor", "netAmountMinor", "lines"]
LINE_KEYS = ["providerTransactionId", "grossAmountMinor", "netAmountMinor"]


def _fields(body: str = "body") -> Column:
    """The body's fields with their values as text.  With the typed parse this is all that is made of the whole text; objects inside are
    looked at as the short texts they are."""
    return F.from_json(F.col(body), "map<string, string>")


def _unknown_field(fields: str) -> str:
    """Whether the body or any object in it has a field that no event has."""
    def strange(names: str, keys: list[str]) -> str:
        known = ", ".join(f"'{k}'" for k in keys)
        return f"coalesce(size(array_except({names}, array({known}))) > 0, false)"

    settlement = f"from_json({fields}['settlement'], 'map<string, string>')"
    lines = f"from_json({settlement}['lines'], 'array<string>')"
    objects = [(strange(f"json_object_keys({fields}['{field}'])", MONEY_KEYS), field) for field in ("gross", "fee", "net")]
    return " or ".join([
        strange(f"map_keys({fields})", PAYLOAD_KEYS), *[f"({fields}['{field}'] is not null and {test})" for test, field in objects],
        f"({fields}['settlement'] is not null and ({strange(f'map_keys({settlement})', SETTLEMENT_KEYS)} or "
        f"coalesce(exists({lines}, line -> {strange('json_object_keys(line)', LINE_KEYS)}), false)))"])


def body_problem(parsed: str = "p", fields: str = "fields") -> Column:
    """Why a body is not a provider event, or null."""
    return F.expr(f"""case when {parsed} is null or {parsed}._corrupt is not null then 'NOT_JSON'
        when {_unknown_field(fields)} then 'UNKNOWN_FIELD'
        when {parsed}.type is null then 'MISSING_TYPE' when {parsed}.occurredAt is null then 'MISSING_OCCURRED_AT'
        when try_to_timestamp({parsed}.occurredAt) is null then 'BAD_OCCURRED_AT' end""")


def occurred_at(parsed: str = "p") -> Column:
    """The instant in UTC, from the whole text with its offset and fraction."""
    local = f"cast(try_to_timestamp({parsed}.occurredAt) as timestamp_ntz)"
    return F.expr(f"convert_timezone(current_timezone(), 'UTC', {local})").alias("occurred_at")


def _read(deliveries: DataFrame) -> DataFrame:
    """``r``: the body read as ``p`` (typed) and ``problem``, once per row."""
    if "r" in deliveries.columns:
        return deliveries
    both = once(deliveries, "both", F.struct(parsed_body().alias("p"), _fields().alias("fields")))
    return once(both, "r", F.struct(F.col("both.p").alias("p"), body_problem("both.p", "both.fields").alias("problem"))).drop("both")


def parse_provider_events(deliveries: DataFrame, accepted: bool = False) -> DataFrame:
    """Typed columns beside ``reject_reason``; good events are the rows where it is null.  ``accepted``: the classification has found every
    body good, so its fields are not judged again."""
    kept = [c for c in deliveries.columns if c != "r"]
    good = F.struct(parsed_body().alias("p"), F.lit(None).cast("string").alias("problem"))
    return (once(deliveries, "r", good) if accepted else _read(deliveries)).select(
        *kept, F.col("r.problem").alias("reject_reason"), F.col("r.p.type").alias("event_type"), occurred_at("r.p"),
        F.col("r.p.providerTransactionId").alias("provider_transaction_id"), F.col("r.p.merchantReference").alias("merchant_reference"),
        F.col("r.p.gross.amountMinor").alias("gross_minor"), F.col("r.p.fee.amountMinor").alias("fee_minor"), F.col("r.p.net.amountMinor").alias("net_minor"),
        F.col("r.p.gross.currency").alias("currency"), F.col("r.p.status").alias("status"), F.col("r.p.settlement").alias("settlement"))


def expected_signature(secret: str) -> Column:
    return hmac_sha256(secret, F.concat("timestamp", F.lit("."), "event_id", F.lit("."), "body"))


def signature_matches(secret: str) -> Column:
    return F.coalesce(F.lower(F.trim("signature")) == expected_signature(secret), F.lit(False))


def verify_event_signature(deliveries: DataFrame, secret: str) -> DataFrame:
    return deliveries.withColumn("signature_valid", signature_matches(secret))


def is_fresh() -> Column:
    received = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', received_at)"
    return F.expr(f"coalesce(abs({received} - try_cast(trim(timestamp) as bigint)) <= {vocab.SIGNATURE_WINDOW_SECONDS}, false)")


def filter_event_freshness(deliveries: DataFrame) -> DataFrame:
    return deliveries.filter(is_fresh())


HTTP_STATUS = """case outcome when 'ACCEPTED' then 202 when 'DUPLICATE' then 200 when 'TOO_LARGE' then 413
    when 'REJECTED_MALFORMED' then 400 else 401 end"""


def checked_deliveries(deliveries: DataFrame, secret: str) -> DataFrame:
    """Row-local part of the classification, also what the stream applies: the body as read ``r``, the first
    refusal that applies (null for a genuine event) and whether the signature was found good."""
    def blank(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    facts = F.struct(
        (F.col("body_bytes") > vocab.MAX_BODY_BYTES).alias("large"), (blank("event_id") | blank("timestamp") | blank("signature")).alias("blank"),
        is_fresh().alias("fresh"), signature_matches(secret).alias("signed"))
    return once(_read(deliveries), "c", facts).withColumn("rejection", F.expr("""case
        when c.large then 'TOO_LARGE' when c.blank then 'REJECTED_MALFORMED' when not c.fresh then 'REJECTED_TIMESTAMP'
        when not c.signed then 'REJECTED_SIGNATURE' when r.problem is not null then 'REJECTED_MALFORMED' end""")).withColumn(
        "signature_valid", F.expr("not coalesce(c.large, false) and not c.blank and c.fresh and c.signed")).drop("c")


def classify_deliveries(deliveries: DataFrame, secret: str) -> DataFrame:
    # Both the winners and the rows they are marked on need the verdict; bodies are parsed and signed once, before that.
    checked = written(checked_deliveries(deliveries, secret).drop("r"), "checked")
    marked = mark_first(checked, EVENT_KEY, ["received_at", "id"], "id", "first", F.col("rejection").isNull())
    outcome = F.expr("case when rejection is not null then rejection when first then 'ACCEPTED' else 'DUPLICATE' end")
    return marked.withColumn("outcome", outcome).withColumn("http_status", F.expr(HTTP_STATUS)).drop("first", "rejection")


def dedupe_provider_events(classified: DataFrame) -> DataFrame:
    """One event per (provider, event_id) with the number of further deliveries; one combinable aggregate."""
    return classified.filter("outcome in ('ACCEPTED', 'DUPLICATE')").groupBy(*EVENT_KEY).agg(
        F.min_by(F.struct(F.col("id").alias("delivery_id"), "received_at", "request_id", "body"), F.struct("received_at", "id")).alias("f"),
        (F.count(F.lit(1)) - 1).alias("duplicate_deliveries")).select(*EVENT_KEY, "f.*", "duplicate_deliveries")


def deliveries_per_event(classified: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in vocab.DELIVERY_OUTCOMES]
    return classified.filter("event_id is not null").groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("deliveries"), *counts)


def payload_hash(deliveries: DataFrame) -> DataFrame:
    return deliveries.withColumn("payload_hash", sha256_text(F.col("body")))


# ------------------------------------------------------------------ settlement reports


def flatten_settlement_report(reports: DataFrame, body: str = "report") -> DataFrame:
    """One row per settlement line (or per settlement without lines) with its 1-based position."""
    one = reports.select("provider", F.explode(F.from_json(F.col(body), f"array<{_SETTLEMENT}>")).alias("s"))
    rows = one.select("provider", "s", F.posexplode_outer("s.lines").alias("pos", "line"))
    return rows.select(
        "provider", F.col("s.providerSettlementId").alias("provider_settlement_id"), F.expr("try_cast(s.settlementDate as date)").alias("settlement_date"),
        F.col("s.currency").alias("currency"), F.col("s.grossAmountMinor").alias("gross_amount_minor"), F.col("s.feeAmountMinor").alias("fee_amount_minor"),
        F.col("s.netAmountMinor").alias("net_amount_minor"), (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.col("line.providerTransactionId").alias("provider_transaction_id"), F.col("line.grossAmountMinor").alias("line_gross_minor"),
        F.col("line.netAmountMinor").alias("line_net_minor"), F.expr("line.grossAmountMinor - line.netAmountMinor").alias("line_fee_minor"))


HEADER = ["provider", "provider_settlement_id", "settlement_date", "currency", "gross_amount_minor", "fee_amount_minor", "net_amount_minor"]


def settlement_headers(reports: DataFrame, body: str = "report") -> DataFrame:
    """One row per reported settlement, with or without lines."""
    return flatten_settlement_report(reports, body).filter("coalesce(line_no, 1) = 1").select(*HEADER)


def _sync_ids(fetched: DataFrame) -> DataFrame:
    return fetched.withColumn("event_id", F.concat(F.lit("sync_"), "provider_settlement_id"))


def sync_settlements(fetched: DataFrame, known_events: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    """Pulled settlements (one row each) of a window of days, both included, that no event has brought yet."""
    if window is not None:
        fetched = fetched.filter(F.col("settlement_date").between(*(F.lit(w).cast("date") for w in window)))
    return _sync_ids(fetched).join(known_events.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def sync_summary(fetched: DataFrame, known_events: DataFrame) -> DataFrame:
    known = known_events.select(*EVENT_KEY).distinct().withColumn("known", F.lit(True))
    return _sync_ids(fetched).join(known, EVENT_KEY, "left").groupBy("provider").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("known").isNull()).alias("ingested"), F.count("known").alias("already_known"))


def normalise_currency(df: DataFrame, column: str = "currency") -> DataFrame:
    clean = F.upper(F.trim(column))
    supported = clean.isin(*vocab.CURRENCIES)
    return df.withColumn("normalised", F.when(supported, clean)).withColumn("rejected", F.coalesce(~supported, F.lit(True)))


def ingest_settlements(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert if absent: the first incoming copy of each settlement that is not stored.  A stored verdict stays as it was."""
    key = ["provider", "provider_settlement_id"]
    return first_per_key(incoming, key, ["received_at", "id"]).join(stored.select(*key), key, "left_anti")


def ingest_settlement_lines(ingested: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of the copies that ``ingest_settlements`` chose, one row per (record, line_no), with the header's key beside them.

    ``lines``: settlement_record_id (the id of the incoming copy), line_no and the line's columns.  Lines of copies that were not
    ingested, and of settlements stored before, are left out, so header and lines are always of one and the same copy.
    """
    chosen = ingested.select(F.col("id").alias("settlement_record_id"), "provider", "provider_settlement_id")
    return lines.join(chosen, "settlement_record_id")


# ------------------------------------------------------------------ event effects


def map_event_target_state(events: DataFrame) -> DataFrame:
    targets = vocab.event_targets(events.sparkSession)
    return events.join(F.broadcast(targets), "event_type", "left").withColumn("routing", F.expr(f"""case
        when event_type = '{vocab.SETTLEMENT_EVENT}' then 'SETTLEMENT' when provider_transaction_id is null then 'DEAD_NO_TRANSACTION'
        when target_state is null then 'DEAD_UNKNOWN_TYPE' else 'PAYMENT' end"""))


# ------------------------------------------------------------------ command log


KEY_OF_COMMAND = ["endpoint", "idem_key"]


def _owners(successors: DataFrame) -> DataFrame:
    """(endpoint, idem_key, nth) of the owners: the first command of each key and whatever is reached from it over ``next``.

    Pointer doubling: each round follows every pointer twice as far and carries the mark along it, so 500 takeovers of one key take
    nine rounds.  A round is one self-join on (key, number) and one combinable aggregate, written once.
    """
    at = [*KEY_OF_COMMAND, "nth"]
    # Only a first command or somebody's successor can own a key.
    named = successors.select(*KEY_OF_COMMAND, F.col("next").alias("nth")).filter("nth is not null").distinct()
    first = successors.filter("nth = 1")
    marked = written(first.unionByName(successors.filter("nth > 1").join(named, at, "left_semi")).withColumn("owns", F.expr("nth = 1")), "command-chain")
    while not marked.filter("next is not null").isEmpty():
        far = marked.select(*KEY_OF_COMMAND, F.col("nth").alias("next"), F.col("next").alias("beyond"))
        ahead = marked.filter("next is not null").join(far, [*KEY_OF_COMMAND, "next"]).select(*at, F.col("beyond").alias("next"), "owns")
        reached = marked.filter("owns and next is not null").select(*KEY_OF_COMMAND, F.col("next").alias("nth"), F.lit(None).cast("bigint").alias("next"), "owns")
        ended = marked.filter("next is null")
        step = ahead.unionByName(reached).unionByName(ended).groupBy(*at).agg(F.max("next").alias("next"), F.max("owns").alias("owns"))
        before, marked = marked, written(step, "command-chain")
        remove(before)
    return marked.filter("owns").select(*at)


def classify_commands(log: DataFrame) -> DataFrame:
    """FRESH, EXPIRED_TAKEOVER, CONFLICT, IN_PROGRESS or REPLAY for each command on (endpoint, idem_key).

    Whoever owns a key owns it until its record expires; the first command at or after that takes over (the next one, if a record expires
    before it begins).  One sorted pass over the commands and their expiries numbers the commands of each key and tells for each the
    number of its successor; the owners are then found by pointer doubling, and every command belongs to the last owner up to it.  No key
    is gathered in a task, and the number of rounds grows with the logarithm of the takeovers.
    """
    log = log.select("id", *KEY_OF_COMMAND, "fingerprint", "ts", "completed", "expires_at")
    # At one instant expiries come first: a command arriving then takes over.
    arrivals = log.withColumn("at", F.col("ts")).withColumn("arrives", F.lit(1))
    expiries = log.filter("expires_at is not null").withColumn("at", F.col("expires_at")).withColumn("arrives", F.lit(0))
    timed = running_sums(
        arrivals.unionByName(expiries), KEY_OF_COMMAND, ["at", "arrives", "id"], {"count": F.col("arrives").cast("bigint")})
    timed = written(timed, "command-times")
    numbered = timed.filter("arrives = 1").withColumnRenamed("count", "nth").drop("arrives", "at")
    sizes = timed.groupBy(*KEY_OF_COMMAND).agg(F.sum("arrives").alias("commands"))
    expiry = timed.filter("arrives = 0").select("id", (F.col("count") + 1).alias("after"))
    successors = numbered.select("id", *KEY_OF_COMMAND, "nth").join(expiry, "id", "left").join(sizes, KEY_OF_COMMAND)
    successors = successors.withColumn("next", F.greatest("after", F.expr("case when after is not null then nth + 1 end")))
    owners = _owners(successors.select(*KEY_OF_COMMAND, "nth", F.expr("case when next <= commands then next end").alias("next")))

    # The number of owners up to a command names its owner.
    flagged = numbered.join(owners.withColumn("owns", F.lit(1)), [*KEY_OF_COMMAND, "nth"], "left")
    placed = written(running_sums(flagged, KEY_OF_COMMAND, ["nth"], {"owner_no": F.coalesce("owns", F.lit(0)).cast("bigint")}), "commands")
    owner = placed.filter("owns = 1").select(*KEY_OF_COMMAND, "owner_no", F.struct("id", "fingerprint", "completed").alias("o"))
    return placed.join(owner, [*KEY_OF_COMMAND, "owner_no"]).select("id", *KEY_OF_COMMAND, "ts", F.col("o.id").alias("owner_id"), F.expr("""case
        when id = o.id then case when nth = 1 then 'FRESH' else 'EXPIRED_TAKEOVER' end
        when fingerprint <> o.fingerprint then 'CONFLICT' when not o.completed then 'IN_PROGRESS' else 'REPLAY' end""").alias("decision"))


def command_fingerprint(log: DataFrame) -> DataFrame:
    canonical = F.concat(F.lit('{"bodyHash":"'), sha256_text(F.col("body")), F.lit('","method":"'), "method",
                         F.lit('","pathTemplate":"'), "path_template", F.lit('"}'))
    return log.withColumn("fingerprint", sha256_text(canonical))


def purge_expired_commands(log: DataFrame, now: str) -> DataFrame:
    """A record expiring exactly now is kept here, although a command arriving now could take it over."""
    return log.filter(F.col("expires_at") >= F.lit(now).cast("timestamp_ntz"))
