"""Column expressions for usage, prices and ledger texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.schemas import BYTES_PER_MESSAGE, PRICES, QUERY_UNITS, Prices, QueryUnits

KB, MB, GB = 1024.0, 1024.0 ** 2, 1024.0 ** 3


def micros(amount: Column) -> Column:
    """A ledger amount, kept at six decimals, as a whole number.

    Sums of these are exact, so totals do not depend on how rows are partitioned.
    """
    return F.round(amount * 1e6).cast("long")


def from_micros(total: Column) -> Column:
    return total / F.lit(1e6)


def query_units(processed_bytes: Column, cpu_ms: Column, peak_bytes: Column, wall_ms: Column,
                weights: QueryUnits = QUERY_UNITS) -> Column:
    def known(x: Column) -> Column:
        return F.coalesce(x.cast("double"), F.lit(0.0))
    raw = (known(processed_bytes) / GB * weights.per_gb
           + known(cpu_ms) / 1000 * weights.per_cpu_second
           + known(peak_bytes) / GB * (known(wall_ms) / 1000) * weights.per_gb_second)
    return F.round(F.greatest(F.lit(weights.floor), raw), 4)


def query_cost(units: Column, prices: Prices = PRICES) -> Column:
    return F.round(units * prices.query_unit, 6)


def data_points(units: Column) -> Column:
    """Units as a whole number, halves to even."""
    return F.bround(units, 0).cast("int")


def message_cost(messages: Column, prices: Prices = PRICES) -> Column:
    return messages * F.lit(prices.message)


def stored_bytes(storage_bytes: Column, messages: Column) -> Column:
    return F.when(storage_bytes > 0, storage_bytes).otherwise(messages * BYTES_PER_MESSAGE)


def storage_cost(stored: Column, prices: Prices = PRICES) -> Column:
    return stored / KB * F.lit(prices.storage_gb / (KB * KB))


def used_percent(used_bytes: Column, allocated_gb: Column) -> Column:
    allocated = F.coalesce(allocated_gb, F.lit(0.0)) * GB
    return F.when(allocated > 0, F.least(used_bytes / allocated * 100, F.lit(100.0))).otherwise(0.0)


def fill_band(percent: Column) -> Column:
    return F.when(percent >= 90, "red").when(percent >= 70, "orange").otherwise("emerald")


def budget_percent(cost: Column, budget: Column) -> Column:
    return F.when(budget > 0, cost / budget * 100)


def budget_level(percent: Column) -> Column:
    return F.when(percent >= 100, "critical").when(percent >= 80, "warning").otherwise("ok")


def storage_residual(cycle: Column, messages: Column, queries: Column) -> Column:
    return F.greatest(F.lit(0.0), cycle - messages - queries)


def amount_due(messages: Column, sensors: Column, subscriptions: Column,
               prices: Prices = PRICES) -> Column:
    return (messages * F.lit(prices.ledger_message) + sensors * F.lit(prices.sensor_onboarding)
            + F.coalesce(subscriptions, F.lit(0.0)))


def next_due(frequency: Column, since: Column) -> Column:
    """Calendar step by billing frequency, month ends clamped; unknown frequencies do not move."""
    return (F.when(frequency == "daily", since + F.expr("INTERVAL 1 DAY"))
            .when(frequency == "weekly", since + F.expr("INTERVAL 7 DAY"))
            .when(frequency == "monthly", since + F.expr("INTERVAL 1 MONTH"))
            .when(frequency == "quarterly", since + F.expr("INTERVAL 3 MONTH"))
            .when(frequency == "yearly", since + F.expr("INTERVAL 1 YEAR"))
            .otherwise(since))


def period_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def card_digits(number: Column) -> Column:
    return F.replace(number, F.lit(" "), F.lit(""))


def card_brand(number: Column) -> Column:
    # Issuer prefixes.
    return (F.when(number.rlike("^4"), "Visa")
            .when(number.rlike("^5[1-5]"), "Mastercard")
            .when(number.rlike("^3[47]"), "Amex")
            .otherwise("Card"))


def card_last4(number: Column) -> Column:
    return F.right(card_digits(number), F.lit(4))


def topup_text(method: Column, card: Column, payer: Column, reference: Column) -> Column:
    # Ledger texts of a top-up.
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    by_mail = lambda name: F.format_string(f"Top-up via {name} (%s)", payer)
    return (F.when((method == "credit_card") & given(card),
                   F.format_string("Top-up via %s ending %s",
                                   card_brand(card_digits(card)), card_last4(card)))
            .when((method == "paypal") & given(payer), by_mail("PayPal"))
            .when((method == "skrill") & given(payer), by_mail("Skrill"))
            .when((method == "revolut") & given(payer), by_mail("Revolut"))
            .when(method == "bank_transfer",
                  F.format_string("Top-up via Wire Transfer (ref: %s)",
                                  F.when(given(reference), reference).otherwise("N/A")))
            .otherwise(F.concat(F.lit("Top-up via "),
                                F.initcap(F.replace(method, F.lit("_"), F.lit(" "))))))


def two_decimals(x: Column) -> Column:
    """Text of a number of at least 1 with two decimals, rounded on its exact binary value.

    Formatting by way of the shortest decimal would round some halves the other way.
    The fraction is a whole number of 2^-52, so whole-number arithmetic is exact.
    """
    unit = 1 << 52
    whole = F.floor(x)
    fraction = ((x - whole) * float(unit)).cast("long") * 100
    cents = F.floor(fraction / F.lit(unit).cast("decimal(20,0)")).cast("long")
    rest = fraction - cents * unit
    up = F.when(rest * 2 > unit, 1).when((rest * 2 == unit) & (cents % 2 == 1), 1).otherwise(0)
    total = whole * 100 + cents + up
    return F.concat(F.floor(total / 100).cast("string"), F.lit("."),
                    F.lpad((total % 100).cast("string"), 2, "0"))


def charge_text(units: Column, sql: Column) -> Column:
    # Ledger text of a query charge; the preview keeps 120 characters.
    return F.concat(F.lit("Query — "), two_decimals(units), F.lit(" QU · "),
                    F.substring(sql, 1, 120))


def cycle_text(messages: Column) -> Column:
    return F.concat(F.lit("Billing cycle charge — "), F.format_number(messages, 0),
                    F.lit(" messages"))


def rate_or_default(override: Column, stored: Column, default: float) -> Column:
    return F.coalesce(override, stored, F.lit(default))
