"""Billing ledger: balances, overdraft freeze, settlement, payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import money
from loam.plans.ordered import Ordered, last_known, running_min, running_sum
from loam.schemas import PRICES, Prices


def balance_after(topups: DataFrame) -> DataFrame:
    """Top-ups with the billing's balance after each."""
    rows = Ordered.of(topups, ["billing_id"], ["created_at", "id"]) \
        .scan(_total=running_sum(money.micros(F.col("amount")))).result()
    return rows.withColumn("balance_after", money.from_micros(F.col("_total"))).drop("_total")


def clamped_counts(changes: DataFrame, keys: list[str], order: list[str], delta: str) -> DataFrame:
    """Running count that never falls below zero.

    With S the plain running sum, the clamped count is S less the lowest value S
    has had so far, counting the start at zero.
    """
    plain = Ordered.of(changes, keys, order).scan(_sum=running_sum(F.col(delta)))
    low = plain.scan(_low=running_min(F.col("_sum"))).result()
    return low.withColumn("sensor_count", F.col("_sum") - F.least(F.lit(0), F.col("_low"))) \
              .drop("_sum", "_low")


def amount_due_series(events: DataFrame, subscriptions: DataFrame, mode: str = "reference",
                      prices: Prices = PRICES) -> DataFrame:
    """Amount due after every event of a billing that stays active.

    In `reference` mode a counter event recomputes the amount from the counters,
    so query charges count only since the last counter event; `additive` keeps them.
    """
    counter = F.col("kind") != "query"
    sums = Ordered.of(events, ["tenant_id"], ["happened_at", "id"]).scan(
        cum_messages=running_sum(F.col("messages")), _sensors=running_sum(F.col("sensors")),
        _cost=running_sum(money.micros(F.col("cost"))))
    marks = sums.scan(_low=running_min(F.col("_sensors")),
                      _counted=last_known(F.when(counter, F.col("_cost"))))
    rows = marks.result().withColumn(
        "cum_sensors", F.col("_sensors") - F.least(F.lit(0), F.col("_low")))
    rows = rows.join(subscriptions, "tenant_id", "left")
    counters = money.amount_due(F.col("cum_messages"), F.col("cum_sensors"),
                                F.col("subscription_cost"), prices)
    dropped = F.coalesce("_counted", F.lit(0)) if mode == "reference" else F.lit(0)
    base = F.when(F.col("_counted").isNotNull(), counters).otherwise(0.0)
    return (rows.withColumn("due", base + money.from_micros(F.col("_cost") - dropped))
            .drop("_sensors", "_cost", "_low", "_counted", "subscription_cost"))


def overdraft_freeze(events: DataFrame, balances: DataFrame, subscriptions: DataFrame,
                     mode: str = "reference", prices: Prices = PRICES) -> DataFrame:
    """State of each billing after one epoch.

    The first event whose amount due exceeds the balance suspends the billing and
    freezes the amount; the counters go on. Both are plain aggregates over the
    series, so a tenant's rows are never gathered in one place.
    """
    rank = F.struct("happened_at", "id")
    over = F.col("due") > F.col("balance")
    series = amount_due_series(events, subscriptions, mode, prices)
    state = series.join(balances, "tenant_id").groupBy("tenant_id").agg(
        F.min_by(F.struct("id", "due"), F.when(over, rank)).alias("_hit"),
        F.max_by(F.struct("due", "cum_messages", "cum_sensors"), rank).alias("_end"))
    return state.select(
        "tenant_id",
        F.when(F.col("_hit").isNotNull(), "suspended").otherwise("active").alias("status"),
        F.col("_hit.id").alias("suspended_by"),
        F.coalesce("_hit.due", "_end.due").alias("amount_due"),
        F.col("_end.cum_messages").alias("message_count"),
        F.col("_end.cum_sensors").alias("sensor_count"))


def settle_cycles(billings: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """End of a billing cycle for every billing at once: new rows and ledger debits."""
    at = F.lit(now).cast("timestamp")
    balance = F.coalesce("balance", F.lit(0.0))
    charged = billings.withColumn("_deduct", F.least(F.col("amount_due"), balance)) \
                      .withColumn("_left", balance - F.col("_deduct"))
    reference = F.concat(F.lit("CYCLE-"), F.upper(F.substring(F.md5(F.concat_ws(
        "|", F.col("billing_id").cast("string"), F.lit(now)).cast("binary")), 1, 8)))
    rows = charged.select(
        "billing_id", "tenant_id", "frequency", F.col("_left").alias("balance"),
        F.lit(0.0).alias("amount_due"), F.lit(0).cast("long").alias("message_count"),
        "sensor_count", at.alias("last_payment_date"),
        money.next_due(F.col("frequency"), at).alias("due_date"),
        F.when(F.col("_left") <= 0, "suspended").otherwise("active").alias("status"))
    debits = charged.select(
        "billing_id", F.lit("debit").alias("type"), F.col("_deduct").alias("amount"),
        F.col("_left").alias("balance_after"),
        money.cycle_text(F.col("message_count")).alias("description"),
        money.period_key(at).alias("usage_period"), F.col("message_count").alias("data_points"),
        reference.alias("reference"), at.alias("created_at"))
    return rows, debits


def reset_on_payment(billings: DataFrame, payments: DataFrame, now: str) -> DataFrame:
    """Billings with a payment start over; the others stay as they are."""
    at = F.lit(now).cast("timestamp")
    paid = payments.select("billing_id").distinct().withColumn("_paid", F.lit(True))
    rows = billings.join(paid, "billing_id", "left")
    hit = F.coalesce("_paid", F.lit(False))
    keep = lambda name, value: F.when(hit, value).otherwise(F.col(name)).alias(name)
    return rows.select(
        "billing_id", keep("message_count", F.lit(0).cast("long")),
        keep("sensor_count", F.lit(0).cast("long")), keep("amount_due", F.lit(0.0)),
        F.when(hit, at).alias("last_payment_date"),
        keep("due_date", money.next_due(F.col("frequency"), at)), keep("status", F.lit("active")))


def overdue(billings: DataFrame, now: str) -> DataFrame:
    return billings.filter(F.col("due_date") < F.lit(now).cast("timestamp"))


def subscription_costs(billings: DataFrame, subscriptions: DataFrame) -> DataFrame:
    costs = subscriptions.groupBy("billing_id").agg(F.sum("cost").alias("subscription_cost"))
    return billings.join(costs, "billing_id", "left").fillna({"subscription_cost": 0.0})


def with_amount_due(billings: DataFrame, prices: Prices = PRICES) -> DataFrame:
    due = money.amount_due(F.col("message_count"), F.col("sensor_count"),
                           F.col("subscription_cost"), prices)
    return billings.withColumn("amount_due", due)


def recount_sensors(billings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensor count of each billing taken from the registry."""
    counts = sensors.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_n"))
    return (billings.join(counts, "tenant_id", "left")
            .withColumn("sensor_count", F.coalesce("_n", F.lit(0))).drop("_n"))


def effective_rates(overrides: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Rates per tenant; a missing override keeps the default."""
    known = {"message_rate": prices.message, "storage_rate": prices.storage_gb,
             "query_rate": prices.query_unit}
    return overrides.select("tenant_id", *[F.coalesce(name, F.lit(value)).alias(name)
                                           for name, value in known.items()])


def deactivate_over_budget(readings: DataFrame, sensors: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """First reading at which an active sensor's cost reaches its budget."""
    watched = sensors.filter((F.col("status") == "active") & (F.col("budget") > 0)) \
                     .select("sensor_id", "budget")
    counted = Ordered.of(
        readings.select("sensor_id", "event_time", "event_id", "increment")
        .join(watched, "sensor_id"),
        ["sensor_id"], ["event_time", "event_id"],
    ).scan(messages=running_sum(F.col("increment"))).result()
    cost = money.message_cost(F.col("messages"), prices)
    reached = counted.withColumn("cost", cost).filter(F.col("cost") >= F.col("budget"))
    first = F.min_by(F.struct("event_id", "event_time", "messages", "cost", "budget"),
                     F.struct("event_time", "event_id"))
    return (reached.groupBy("sensor_id").agg(first.alias("_f")).select("sensor_id", "_f.*")
            .withColumn("status", F.lit("inactive")))
