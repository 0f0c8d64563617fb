"""Billing state after a whole history of account events, for any volume of events.

Only top-ups and cycle ends have to be taken in order; they are few. The events
between two of them form a stretch. One distributed pass computes what each
stretch would cost if the billing stayed active and reduces it to one row. The
stretches of a tenant are then settled in order, from a bounded number of values each:
besides its totals a stretch has the highest amounts of up to 256 blocks of its events. The
amount at which a suspended stretch was frozen is the first one above the balance, so these
tell the block that holds it; where a block is one event, they tell the amount itself. In
longer stretches the events of that one block are looked up, only where the amount is used
later, for all tenants at once, and these tenants are settled again.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import money
from loam.plans.ordered import Ordered, last_known, running_min, running_sum
from loam.schemas import PRICES, Prices
from loam.session import scratch

SETTLED = "tenant_id string, status string, balance double, amount_due double, message_count long, sensor_count long, last_id long"
ASKED = "stretch long, above double, base double, lo long, hi long"
BLOCKS = 256
"""Blocks of events that a stretch keeps the highest amounts of."""
# What workers run is sent to them, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_series(events: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Events with their stretch, the counters and the amount due of an active billing.

    Before the first counter event of a stretch the amount due is only known
    relative to what it was when the stretch began; `charged` holds that part.
    """
    kind, quantity = F.col("kind"), F.col("quantity")
    control = kind.isin("topup", "cycle")
    counter = kind.isin("messages", "sensors")
    charge = F.when(kind == "query", money.micros(F.col("amount"))).otherwise(0)
    sums = Ordered.of(events, ["tenant_id"], ["happened_at", "id"]).scan(
        stretch=running_sum(F.when(control, 1).otherwise(0)),
        _messages=running_sum(F.when(kind == "messages", quantity).otherwise(0)),
        _sensors=running_sum(F.when(kind == "sensors", quantity).otherwise(0)),
        number=running_sum(F.lit(1)),
        _cost=running_sum(charge))
    marks = sums.scan(
        _low=running_min(F.col("_sensors")),
        _settled=last_known(F.when(kind == "cycle", F.col("_messages"))),
        _begun=last_known(F.when(control, F.col("_cost"))),
        _counted=last_known(F.when(counter, F.col("_cost"))),
        _counted_in=last_known(F.when(counter, F.col("stretch"))))
    messages = F.col("_messages") - F.coalesce("_settled", F.lit(0))
    sensors = F.col("_sensors") - F.least(F.lit(0), F.col("_low"))
    known = F.coalesce(F.col("_counted_in") == F.col("stretch"), F.lit(False))
    due = (money.amount_due(messages, sensors, F.lit(0.0), prices)
           + money.from_micros(F.col("_cost") - F.col("_counted")))
    begun = F.col("_cost") - F.coalesce("_begun", F.lit(0))
    return marks.result().select(
        "tenant_id", "stretch", "happened_at", "id", "number",
        F.when(control, kind).alias("control"), F.when(control, F.col("amount")).alias("paid"),
        messages.alias("message_count"), sensors.alias("sensor_count"),
        F.when(~control & known, due).alias("due"),
        F.when(~control & ~known, money.from_micros(begun)).alias("charged"))


def stretches(series: DataFrame) -> DataFrame:
    """One row per stretch: what begins it, its highest and last amounts, its end counters, and its blocks.

    The events of a stretch, from number `begin` on, are cut into blocks of `size`; `dues`
    and `charges` are the highest amounts of each, lowest of all where a block has none.
    """
    rank = F.struct("happened_at", "id")
    end = F.max_by(F.struct("message_count", "sensor_count", "id"), rank)
    last = F.max_by("due", F.when(F.col("due").isNotNull(), rank))
    totals = series.groupBy("tenant_id", "stretch").agg(
        F.min("number").alias("begin"), F.ceil(F.count("*") / BLOCKS).alias("size"), F.max("control").alias("control"), F.max("paid").alias("paid"),
        F.max("charged").alias("charged"), F.max("due").alias("highest"), last.alias("last_due"),
        end.alias("_end")).select("*", "_end.*").drop("_end")
    none = F.lit(float("-inf"))
    blocks = _of_tenant(series.select("tenant_id", "stretch", "number", "due", "charged"), totals.select("tenant_id", "stretch", "begin", "size"), "inner", ["stretch"]) \
        .groupBy("tenant_id", "stretch", F.floor((F.col("number") - F.col("begin")) / F.col("size")).alias("block")) \
        .agg(F.coalesce(F.max("due"), none).alias("due"), F.coalesce(F.max("charged"), none).alias("charge"))
    blocks = blocks.groupBy("tenant_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("block", "due", "charge"))).alias("blocks"))
    blocks = blocks.select("tenant_id", "stretch", F.col("blocks.due").alias("dues"), F.col("blocks.charge").alias("charges"))
    return _of_tenant(totals, blocks, "inner", ["stretch"])


def _of_tenant(frame: DataFrame, other: DataFrame, how: str, also: list[str]) -> DataFrame:
    """Joins by tenant, a null one included, and `also`; keeps the columns of `frame` and those only `other` has."""
    named = other.select(*[F.col(c).alias(f"_{c}" if c in ("tenant_id", *also) else c) for c in other.columns])
    on = F.col("tenant_id").eqNullSafe(F.col("_tenant_id"))
    for c in also:
        on = on & (F.col(c) == F.col(f"_{c}"))
    joined = frame.join(named, on, how)
    return joined if how == "left_semi" else joined.drop("_tenant_id", *[f"_{c}" for c in also])


def frozen_amounts(series: DataFrame, asked: DataFrame) -> DataFrame:
    """(tenant_id, stretch, frozen) of the blocks asked for: the first amount above the balance."""
    amount = F.coalesce("due", F.col("base") + F.col("charged"))
    over = F.when(amount > F.col("above"), F.struct("happened_at", "id"))
    found = _of_tenant(series.select("tenant_id", "stretch", "happened_at", "id", "number", "due", "charged"), asked, "inner", ["stretch"])
    return found.where((F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))) \
        .groupBy("tenant_id", "stretch").agg(F.min_by(amount, over).alias("frozen"))


def first_above(row, balance: float, began: float) -> tuple[float | None, int, int]:
    """The first amount of a stretch above the balance, or None and the numbers of the events it is among."""
    amounts = np.maximum(row.dues, began + np.asarray(row.charges))
    block = int(np.argmax(amounts > balance))
    begin = row.begin + block * row.size
    return (float(amounts[block]) if row.size == 1 else None), begin, begin + row.size


def settle(rows: pd.DataFrame) -> tuple:
    """State after a tenant's stretches, taken in order, or the frozen amount that is needed to go on.

    `open_` is (stretch, balance, amount before it, numbers of the events it is among) while
    the amount due is a frozen one that is not known; it exceeds that balance.
    """
    status, balance, due, open_ = "active", 0.0, 0.0, None
    need = lambda: (None,) * 6 + open_
    for row in rows.sort_values("stretch").itertuples():
        if row.control == "topup":
            balance, status = balance + row.paid, "active"
        elif row.control == "cycle":
            if open_ and balance > open_[1]:
                return need()
            balance -= balance if open_ else min(due, balance)
            due, open_ = 0.0, None
            status = "suspended" if balance <= 0 else "active"
        if status != "active":
            continue
        began, over = due, False
        if pd.notna(row.charged):
            if open_:
                return need()
            due = began + row.charged
            over = due > balance
        if not over and pd.notna(row.highest):
            over, due, began, open_ = row.highest > balance, row.last_due, 0.0 if open_ else began, None
        if over:
            status = "suspended"
            amount, lo, hi = first_above(row, balance, began)
            if amount is not None:
                due = amount
            elif pd.notna(row.asked):
                due = float("inf") if pd.isna(row.frozen) else row.frozen
            else:
                due, open_ = float("inf"), (row.stretch, balance, began, lo, hi)
    if open_:
        return need()
    final = rows.loc[rows["stretch"].idxmax()]
    return status, balance, due, final["message_count"], final["sensor_count"], final["id"], None, None, None, None, None


def _settle_tenant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    names = [part.split()[0] for part in f"{SETTLED}, {ASKED}".split(", ")]
    return pd.DataFrame([(key[0], *settle(rows))], columns=names)


def _stored(frame: DataFrame, purpose: str) -> DataFrame:
    folder = scratch(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def account_states(events: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """State of every tenant; a tenant's stretches, not its events, meet in one task.

    There are as many rounds as one tenant has frozen amounts that later ones depend on in
    stretches of more than 256 events; a tenant without such is settled at once. The states
    of each round are added to one table.
    """
    series = _stored(event_series(events, prices), "billing-series")
    left = _stored(stretches(series), "billing-stretches")
    known = left.select("tenant_id", "stretch", F.lit(None).cast("double").alias("frozen"), F.lit(True).alias("asked")).limit(0)
    states = scratch(events.sparkSession, "billing-states")
    while True:
        settled = _stored(_of_tenant(left, known, "left", ["stretch"]).groupBy("tenant_id").applyInPandas(_settle_tenant, f"{SETTLED}, {ASKED}"), "billing-settled")
        ended = settled.where("stretch is null").drop("stretch", "above", "base", "lo", "hi")
        ended.write.mode("append").parquet(states)
        asked = settled.where("stretch is not null").select("tenant_id", "stretch", "above", "base", "lo", "hi")
        if asked.isEmpty():
            return events.sparkSession.read.schema(ended.schema).parquet(states)
        known = _stored(known.union(frozen_amounts(series, asked).withColumn("asked", F.lit(True))), "billing-frozen")
        left = _stored(_of_tenant(left, asked.select("tenant_id"), "left_semi", []), "billing-stretches")
