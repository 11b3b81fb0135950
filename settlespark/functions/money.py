"""Money in integer minor units: half-up fees, checks and text.  No floating point."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from settlespark.vocab import BPS_DENOMINATOR, MAX_AMOUNT_MINOR


def minor_units(price: str) -> Column:
    """The only place a floating price enters: ``floor(price * 100 + 0.5)`` as a whole number."""
    return F.expr(f"cast(floor({price} * 100 + 0.5) as bigint)")


def half_up_fee(amount: str, bps: str) -> Column:
    half = BPS_DENOMINATOR // 2
    return F.expr(f"cast(({amount} * {bps} + {half}) div {BPS_DENOMINATOR} as bigint)")


def amount_problem(amount: Column) -> Column:
    """Why an amount is not acceptable money, or null."""
    return (
        F.when(amount.isNull(), "MISSING")
        .when(amount < 0, "NEGATIVE")
        .when(amount > MAX_AMOUNT_MINOR, "ABOVE_LIMIT")
    )


def money_text(currency: str, amount: str) -> Column:
    """``EGP 100.00`` from whole and remainder of the minor units."""
    return F.expr(
        f"concat({currency}, ' ', case when {amount} < 0 then '-' else '' end, "
        f"cast(abs({amount}) div 100 as string), '.', lpad(cast(abs({amount}) % 100 as string), 2, '0'))"
    )
