"""Fixed values the results depend on: vocabularies, ranks, limits and seeded dimension rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -----------------------------------------------------------------------------
CURRENCIES = ["EGP", "USD", "EUR", "GBP"]
CURRENCY_EXPONENT = 2

MAX_AMOUNT_MINOR = 10**12
BPS_DENOMINATOR = 10_000

# Payment states in their ordinal order; the provider-status rank is the position counted from 1.
PAYMENT_STATES = ["CREATED", "AUTHORIZED", "CAPTURED", "SETTLED", "FAILED", "REFUNDED"]
ALLOWED_TRANSITIONS = [
    ("CREATED", "AUTHORIZED"),
    ("CREATED", "FAILED"),
    ("AUTHORIZED", "CAPTURED"),
    ("AUTHORIZED", "FAILED"),
    ("CAPTURED", "SETTLED"),
    ("CAPTURED", "REFUNDED"),
    ("SETTLED", "REFUNDED"),
]

EVENT_TARGETS = [
    ("payment.created", "CREATED"),
    ("payment.authorized", "AUTHORIZED"),
    ("payment.captured", "CAPTURED"),
    ("payment.settled", "SETTLED"),
    ("payment.refunded", "REFUNDED"),
    ("payment.failed", "FAILED"),
]
SETTLEMENT_EVENT = "settlement.paid"

# (id, code, name, account_type, normal_side, state)
LEDGER_ACCOUNTS = [
    ("acct_psp_clearing", "PSP_CLEARING", "Receivable from the PSP", "ASSET", "DEBIT", "ACTIVE"),
    ("acct_platform_cash", "PLATFORM_CASH", "Platform cash", "ASSET", "DEBIT", "ACTIVE"),
    ("acct_merchant_payable", "MERCHANT_PAYABLE", "Amount owed to merchants", "LIABILITY", "CREDIT", "ACTIVE"),
    ("acct_platform_fee_rev", "PLATFORM_FEE_REVENUE", "Platform fee revenue", "REVENUE", "CREDIT", "ACTIVE"),
    ("acct_psp_fee_exp", "PSP_FEE_EXPENSE", "Fees charged by the PSP", "EXPENSE", "DEBIT", "ACTIVE"),
]

LEDGER_TYPES = [
    "PAYMENT_CAPTURE", "REVERSAL", "PAYMENT_REFUND_SETTLED",
    "SETTLEMENT_RECEIVED", "MERCHANT_PAYOUT", "PSP_ADJUSTMENT",
]
SOURCE_TYPES = ["PAYMENT", "SETTLEMENT_RECORD", "PAYOUT", "RECONCILIATION_CASE", "SYSTEM"]
LINK_ROLES = ["CAPTURE", "REFUND", "SETTLEMENT", "ADJUSTMENT", "REVERSAL"]
TRIGGER_TYPES = ["API", "WEBHOOK", "SETTLEMENT", "SYSTEM"]
DELIVERY_OUTCOMES = [
    "ACCEPTED", "DUPLICATE", "REJECTED_SIGNATURE",
    "REJECTED_TIMESTAMP", "REJECTED_MALFORMED", "TOO_LARGE",
]
EVENT_STATUSES = ["PENDING", "PROCESSING", "PROCESSED", "NO_EFFECT", "FAILED", "DEAD"]
PAYOUT_STATUSES = ["PLANNED", "EXECUTED"]
BATCH_STATUSES = ["RUNNING", "COMPLETED", "FAILED"]
CASE_STATUSES = ["OPEN", "INVESTIGATING", "RESOLVED", "WRITTEN_OFF"]
WRITE_OFF_ACTIONS = [
    "PROVIDER_ERROR_CONFIRMED", "INTERNAL_ERROR_CONFIRMED",
    "DUPLICATE_OF_CASE", "TIMING_DIFFERENCE", "OTHER",
]
AUDIT_ENTITY_TYPES = [
    "PAYMENT", "PAYOUT_RECORD", "PROVIDER", "PROVIDER_EVENT", "SETTLEMENT_RECORD",
    "RECONCILIATION_BATCH", "RECONCILIATION_RESULT", "RECONCILIATION_CASE", "IDEMPOTENCY_RECORD",
]

# (outcome, requires_case, severity)
OUTCOMES = [
    ("MATCHED", False, "LOW"),
    ("MATCHED_NOT_SETTLED", False, "LOW"),
    ("AMOUNT_MISMATCH", True, "HIGH"),
    ("CURRENCY_MISMATCH", True, "HIGH"),
    ("STATUS_MISMATCH", True, "HIGH"),
    ("REFERENCE_MISMATCH", True, "MEDIUM"),
    ("SETTLEMENT_DATE_MISMATCH", True, "LOW"),
    ("MISSING_ON_PROVIDER", True, "MEDIUM"),
    ("MISSING_INTERNAL", True, "MEDIUM"),
    ("DUPLICATE_PROVIDER_RECORD", True, "HIGH"),
    ("AMBIGUOUS_MATCH", True, "MEDIUM"),
    ("SETTLEMENT_RECORD_INVALID", True, "HIGH"),
]

SIGNATURE_WINDOW_SECONDS = 300
MAX_BODY_BYTES = 256 * 1024
MAX_ATTEMPTS = 8
MAX_DEFERRALS = 100
BACKOFF_BASE_SECONDS = 2
BACKOFF_CAP_SECONDS = 300
STALE_CLAIM_SECONDS = 300
BATCH_LEASE_MINUTES = 30
MINIMUM_NOTE_LENGTH = 20
# ---- end of fixed values ----------------------------------------------------------------------


def state_rank(state: str) -> int:
    return PAYMENT_STATES.index(state) + 1


def dimension(spark: SparkSession, rows: list, columns: str) -> DataFrame:
    """A dimension of fixed size as an inline table, so Catalyst knows how small it is."""

    def literal(value) -> str:
        if value is None:
            return "null"
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({columns})")


def ledger_accounts(spark: SparkSession) -> DataFrame:
    return dimension(spark, LEDGER_ACCOUNTS, "id, code, name, account_type, normal_side, state")


def currency_units(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(c, CURRENCY_EXPONENT, True) for c in CURRENCIES], "code, exponent, active")


def outcome_map(spark: SparkSession) -> DataFrame:
    return dimension(spark, OUTCOMES, "outcome, requires_case, severity")


def allowed_transitions(spark: SparkSession) -> DataFrame:
    return dimension(spark, ALLOWED_TRANSITIONS, "from_state, to_state")


def payment_states(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(s, state_rank(s)) for s in PAYMENT_STATES], "state, rank")


def event_targets(spark: SparkSession) -> DataFrame:
    return dimension(spark, EVENT_TARGETS, "event_type, target_state")
