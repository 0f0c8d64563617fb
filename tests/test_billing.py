"""Ledger behaviour on literal cases."""

import datetime
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loam.functions import money
from loam.operators import account_history, billing, metering
from loam.plans import ordered

EVENT = "tenant_id string, happened_at timestamp, id long, kind string, messages long, sensors int, cost double"
T0 = datetime.datetime(2026, 1, 1)


def freeze(spark, events, balance, subscription=0.0, **options):
    data = [("t", T0, i, kind, m, s, c) for i, (kind, m, s, c) in enumerate(events)]
    return billing.overdraft_freeze(
        spark.createDataFrame(data, EVENT), spark.createDataFrame([("t", balance)], "tenant_id string, balance double"),
        spark.createDataFrame([("t", subscription)], "tenant_id string, subscription_cost double"), **options).first()


def test_messages_overdraw(spark):
    row = freeze(spark, [("messages", 200_000, 0, 0.0)], 0.10)
    assert row.status == "suspended" and row.amount_due == pytest.approx(0.20)


def test_one_sensor_overdraws(spark):
    assert freeze(spark, [("sensors", 0, 1, 0.0)], 0.50).status == "suspended"


def test_exact_balance_is_not_overdrawn(spark):
    assert freeze(spark, [("sensors", 0, 1, 0.0)], 1.0).status == "active"


def test_amount_is_frozen_while_counters_grow(spark):
    row = freeze(spark, [("sensors", 0, 5, 0.0), ("messages", 50_000, 0, 0.0)], 4.0)
    assert (row.status, row.amount_due, row.message_count) == ("suspended", 5.0, 50_000)


def test_counter_event_forgets_query_charges_unless_additive(spark):
    events = [("query", 0, 0, 2.0), ("sensors", 0, 1, 0.0), ("query", 0, 0, 0.5)]
    assert freeze(spark, events, 100.0).amount_due == pytest.approx(1.5)
    assert freeze(spark, events, 100.0, mode="additive").amount_due == pytest.approx(3.5)


def test_subscriptions_count_from_the_first_counter_event(spark):
    assert freeze(spark, [("query", 0, 0, 2.0)], 100.0, 7.0).amount_due == pytest.approx(2.0)
    assert freeze(spark, [("messages", 0, 0, 0.0)], 100.0, 7.0).amount_due == pytest.approx(7.0)


def billing_rows(spark, balance, due, messages=1000):
    return spark.createDataFrame(
        [(1, "t", "monthly", balance, due, messages, 2)],
        "billing_id long, tenant_id string, frequency string, balance double, amount_due double, "
        "message_count long, sensor_count long")


@pytest.mark.parametrize("balance,due,left,status", [
    (3.0, 5.0, 0.0, "suspended"), (2.0, 5.0, 0.0, "suspended"), (20.0, 5.0, 15.0, "active"),
    (10.0, 4.0, 6.0, "active"), (None, 4.0, 0.0, "suspended")])
def test_settlement(spark, balance, due, left, status):
    rows, debits = billing.settle_cycles(billing_rows(spark, balance, due), "2026-01-31 12:00:00")
    row, debit = rows.first(), debits.first()
    assert (row.balance, row.amount_due, row.message_count, row.status) == (left, 0.0, 0, status)
    assert row.due_date == datetime.datetime(2026, 2, 28, 12)
    assert debit.amount == (balance or 0.0) - left and debit.balance_after == left
    assert debit.data_points == 1000 and debit.reference.startswith("CYCLE-")
    assert debit.description == "Billing cycle charge — 1,000 messages" and debit.usage_period == "2026-01"


@pytest.mark.parametrize("frequency,due", [
    ("daily", "2026-02-01"), ("weekly", "2026-02-07"), ("monthly", "2026-02-28"), ("quarterly", "2026-04-30"),
    ("yearly", "2027-01-31"), ("never", "2026-01-31")])
def test_next_due(spark, frequency, due):
    at = F.lit("2026-01-31 12:00:00").cast("timestamp")
    got = spark.range(1).select(money.next_due(F.lit(frequency), at)).first()[0]
    assert got == datetime.datetime.fromisoformat(due + " 12:00:00")


def test_topups_add_up(spark, rows):
    data = [(1, 1, 20.0, T0), (1, 2, 50.0, T0), (2, 3, 5.0, T0)]
    frame = spark.createDataFrame(data, "billing_id long, id long, amount double, created_at timestamp")
    assert rows(billing.balance_after(frame), "id", "balance_after") == [(1, 20.0), (2, 70.0), (3, 5.0)]


@pytest.mark.parametrize("card,brand,last4", [
    ("4111 1111 1111 1234", "Visa", "1234"), ("5500 0000 0000 0004", "Mastercard", "0004"),
    ("5600 0000 0000 0004", "Card", "0004"), ("3782 8224 6310 005", "Amex", "0005"), ("6011000", "Card", "1000")])
def test_cards(spark, card, brand, last4):
    number = F.lit(card)
    got = spark.range(1).select(money.card_brand(money.card_digits(number)), money.card_last4(number)).first()
    assert tuple(got) == (brand, last4)


@pytest.mark.parametrize("stats,units,cost", [
    ((0, 0, 0, 0), 1.0, 0.01), ((None, None, None, None), 1.0, 0.01),
    ((2 * 1024 ** 3, 3000, 1024 ** 3, 4000), 10.0, 0.10)])
def test_query_units(spark, stats, units, cost):
    frame = spark.createDataFrame([stats], "processed_bytes long, cpu_ms long, peak_mem_bytes long, wall_ms long")
    row = metering.with_query_cost(frame).first()
    assert (row.qu, row.cost) == (units, cost)


@pytest.mark.parametrize("units,points", [(0.5, 0), (1.5, 2), (2.5, 2), (3.5, 4), (2.4999, 2)])
def test_data_points_round_half_to_even(spark, units, points):
    assert spark.range(1).select(money.data_points(F.lit(units))).first()[0] == points


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.floats(1, 1e6), st.integers(1000, 10 ** 7).map(lambda n: n / 1000)),
                min_size=50, max_size=50))
def test_two_decimals_is_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in frame.select(money.two_decimals(F.col("x"))).collect()]
    assert got == [f"{v:.2f}" for v in values]


UUID = "0d9f6a3e-52f1-4c1b-9a57-3f0a2b7c8d9e"


def test_mentions_count_by_letters_and_tenant(spark, rows):
    """An id inside a longer one counts, as it does for one sensor's spend; signs of patterns are letters."""
    data = [("QRY-1", 1.0, 2, "Query on S-123 and s-9", 1), ("QRY-2", 2.0, 3, "select 's-12'", 1), ("TXN-3", 9.0, 9, "s-12", 1),
            ("QRY-4", 4.0, 1, "farm F-7 only", 1), ("QRY-5", 5.0, 1, "s-12 s-12 s-1", 1), ("QRY-6", 7.5, 75, "on s-1", 2),
            ("QRY-9", 2.5, 1, "q 100%_x", 2), ("QRY-10", 1.5, 1, None, 2), ("QRY-7", 3.0, 4, f"WHERE id='{UUID.upper()}'", 2), ("QRY-8", 6.0, 1, "s-1", 99)]
    ledger = spark.createDataFrame(data, "reference string, amount double, data_points long, description string, billing_id long")
    billings = spark.createDataFrame([(1, "a"), (2, "b")], "billing_id long, tenant_id string")
    own = [("a", "s-1", "f-7"), ("a", "s-12", "f-7"), ("a", "s-123", "f-7"), ("a", "s-5", "f-7"), ("a", "s-6", "f-1"),
           ("b", "q", "f-9"), ("b", "0%_x", ""), ("b", "1_0", None), ("b", "s-1", "f-7"), ("b", UUID, "f-7"), ("b", "s-5", "f-7")]
    sensors = spark.createDataFrame(own, "tenant_id string, sensor_id string, farm_id string")
    got = rows(metering.query_spend_by_sensor(ledger, sensors, billings), "tenant_id", "sensor_id", "query_count", "total_qu", "total_cost")
    assert got == sorted([
        ("a", "s-1", 3, 6.0, 8.0), ("a", "s-12", 3, 6.0, 8.0), ("a", "s-123", 1, 2.0, 1.0), ("a", "s-5", 1, 1.0, 4.0), ("a", "s-6", 0, 0.0, 0.0),
        ("b", "q", 1, 1.0, 2.5), ("b", "0%_x", 1, 1.0, 2.5), ("b", "1_0", 0, 0.0, 0.0), ("b", "s-1", 1, 75.0, 7.5), ("b", UUID, 1, 4.0, 3.0), ("b", "s-5", 0, 0.0, 0.0)], key=repr)


def shuffled_records(node):
    """Records that the exchanges of a plan wrote, once it has run."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return shuffled_records(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return shuffled_records(node.plan())
    own = node.metrics().get("shuffleRecordsWritten")
    children = node.children()
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled_records(children.apply(i)) for i in range(children.size()))


def test_mentions_shuffle_only_what_begins_like_an_id(spark):
    """Long texts have many pieces, ids much in common; without broadcasts by size, as where there are many ids."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.range(300).selectExpr("id AS charge", "'a' AS tenant_id", "concat(repeat('select all rows of the table, ', 8), 's-', 100000 + id) AS text")
        ids = spark.range(3000).selectExpr("'a' AS tenant_id", "concat('s-', 100000 + id) AS id")
        found = metering.mentions(texts, ids)
        assert sorted(r.id for r in found.collect()) == [f"s-{100000 + n}" for n in range(300)]
        assert shuffled_records(found._jdf.queryExecution().executedPlan()) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mentions_match_brute_force(spark, rows):
    """Few letters, so that ids lie inside each other and come more than once in a text."""
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("ab\u00e9\U0001f600%") for _ in range(rng.randrange(most + 1)))
    texts = [(n, rng.choice("xy"), rng.choice([None, *[word(14)] * 9])) for n in range(120)] + [(200, None, "ab"), (201, "x", "")]
    texts += texts[:5]
    ids = [(rng.choice("xy"), word(7)) for _ in range(80)] + [(None, "a"), ("x", None), ("x", ""), ("z", "a")]
    got = metering.mentions(spark.createDataFrame(texts, "charge int, tenant_id string, text string"),
                            spark.createDataFrame(ids, "tenant_id string, id string").repartition(3))
    assert rows(got) == sorted([(c, t, i) for c, t, text in texts for u, i in set(ids) if i and t and t == u and text and i in text], key=repr)


def test_metered_runs_pass_the_gate_once(spark, rows):
    stats = spark.createDataFrame([(1, "a", 5, 0, 0, 0, 0, T0, "SELECT 1"), (2, "b", 5, 0, 0, 0, 0, T0, "SELECT 2")],
                                  "query_id long, tenant_id string, user_id long, processed_bytes long, cpu_ms long, peak_mem_bytes long, wall_ms long, "
                                  "run_at timestamp, sql string")
    billings = spark.createDataFrame([("a", "active"), ("a", "active"), ("b", "suspended")], "tenant_id string, status string")
    assert rows(metering.gate_queries(stats, billings), "query_id", "allowed") == [(1, True), (2, False)]
    assert rows(metering.metered_runs(stats, billings), "query_id", "type", "amount", "data_points", "usage_period") == [(1, "usage", 0.01, 1, "2026-01")]


def one_by_one(state, events):
    """The billing rules taken one event at a time."""
    status, balance, due, messages, sensors, last = state
    for kind, quantity, amount, last in events:
        if kind == "topup":
            balance, status = balance + amount, "active"
        elif kind == "cycle":
            balance -= min(due, balance)
            due, messages = 0.0, 0
            status = "suspended" if balance <= 0 else "active"
        else:
            messages += quantity if kind == "messages" else 0
            sensors = max(0, sensors + quantity) if kind == "sensors" else sensors
            if status == "active":
                due = due + amount if kind == "query" else messages * (0.10 / 100000) + sensors * 1.0
                status = "suspended" if due > balance else status
    return status, balance, due, messages, sensors, last


def same(folded, wanted):
    assert (folded.status, folded.message_count, folded.sensor_count, folded.last_id) == (wanted[0], *wanted[3:])
    assert folded.balance == pytest.approx(wanted[1], abs=1e-6)
    assert folded.amount_due == pytest.approx(wanted[2], abs=1e-6)


ACCOUNT = "tenant_id string, happened_at timestamp, id long, kind string, quantity long, amount double"
NEW = ("active", 0.0, 0.0, 0, 0, -1)


def states_of(spark, feeds):
    """States of tenants 0, 1, ... after their lists of (kind, quantity, amount)."""
    data = [(str(t), T0, i, *e) for t, events in enumerate(feeds) for i, e in enumerate(events)]
    return {int(r.tenant_id): r for r in account_history.account_states(spark.createDataFrame(data, ACCOUNT)).collect()}


def test_states_on_literal_events(spark):
    got = states_of(spark, [
        [("topup", 0, 0.10), ("messages", 200_000, 0.0), ("messages", 50_000, 0.0)],
        [("topup", 0, 0.10), ("messages", 200_000, 0.0), ("cycle", 0, 0.0)],
        [("topup", 0, 20.0), ("sensors", 5, 0.0), ("query", 0, 1.0), ("cycle", 0, 0.0)],
        [("sensors", -3, 0.0), ("sensors", 2, 0.0)],
        [("topup", 0, 1.0), ("query", 0, 0.7), ("query", 0, 0.7), ("query", 0, 0.7), ("topup", 0, 1.0), ("query", 0, 0.2)]])
    assert (got[0].status, got[0].message_count) == ("suspended", 250_000) and got[0].amount_due == pytest.approx(0.20)
    assert (got[1].status, got[1].balance, got[1].amount_due, got[1].message_count) == ("suspended", 0.0, 0.0, 0)
    assert (got[2].status, got[2].balance, got[2].amount_due) == ("active", 14.0, 0.0)
    assert got[3].sensor_count == 2
    assert (got[4].status, got[4].amount_due) == ("active", pytest.approx(1.6))


@pytest.mark.parametrize("blocks", [256, 4, 1])
def test_states_equal_the_rules_one_by_one_over_many_feeds(spark, monkeypatch, blocks):
    """Amounts off the sensor fee's grid, so that no sum lands exactly on a balance."""
    monkeypatch.setattr(account_history, "BLOCKS", blocks)
    rng = random.Random(11)
    make = [lambda: ("messages", rng.randrange(400_000), 0.0), lambda: ("sensors", rng.randrange(-3, 4), 0.0),
            lambda: ("query", 0, rng.randrange(1, 3000) / 1000), lambda: ("topup", 0, rng.randrange(1, 9) + 0.0001234), lambda: ("cycle", 0, 0.0)]
    feeds = [[rng.choice(make)() for _ in range(rng.randrange(1, 60))] for _ in range(400)]
    got = states_of(spark, feeds)
    for t, events in enumerate(feeds):
        same(got[t], one_by_one(NEW, [(*e, i) for i, e in enumerate(events)]))


def test_stretches_have_a_bounded_size(spark, monkeypatch):
    """A tenant whose events all lie in one stretch takes one row of bounded length; a chain of frozen amounts is settled right."""
    growing = [("messages", 1000, 0.0)] * 3000
    chain = [e for i in range(5) for e in (("query", 0, 1.3), ("query", 0, 1.1 + i), ("topup", 0, 1.0001))]
    feeds = [growing, [("topup", 0, 1.00005), *growing], chain, [*chain, ("cycle", 0, 0.0)], [*chain, ("sensors", 2, 0.0), ("topup", 0, 90.0), ("query", 0, 1.0)]]
    data = [(str(t), T0, i, *e) for t, events in enumerate(feeds) for i, e in enumerate(events)]
    reduced = account_history.stretches(account_history.event_series(spark.createDataFrame(data, ACCOUNT))).collect()
    assert max(len(r.dues) for r in reduced) == max(len(r.charges) for r in reduced) == 251  # the top-up and 3,000 events by 12
    for blocks in (256, 1):
        rounds = []
        asked = account_history.frozen_amounts
        monkeypatch.setattr(account_history, "BLOCKS", blocks)
        monkeypatch.setattr(account_history, "frozen_amounts", lambda *a: rounds.append(1) or asked(*a))
        got = states_of(spark, feeds)
        monkeypatch.setattr(account_history, "frozen_amounts", asked)
        assert len(rounds) <= 1 if blocks == 256 else len(rounds) > 1  # only the long stretch is looked up
        for t, events in enumerate(feeds):
            same(got[t], one_by_one(NEW, [(*e, i) for i, e in enumerate(events)]))


def test_states_equal_the_freeze_of_one_epoch(tables):
    """The settled history and the set-based freeze agree for every tenant."""
    frozen = {r.tenant_id: r for r in billing.overdraft_freeze(
        tables.epoch_events, tables.balances, tables.subscriptions.withColumn("subscription_cost", F.lit(0.0))).collect()}
    opening = tables.balances.select("tenant_id", F.lit("1900-01-01").cast("timestamp").alias("happened_at"), F.lit(-1).cast("long").alias("id"),
                                     F.lit("topup").alias("kind"), F.lit(0).cast("long").alias("quantity"), F.col("balance").alias("amount"))
    events = tables.epoch_events.select("tenant_id", "happened_at", "id", "kind", (F.col("messages") + F.col("sensors")).cast("long").alias("quantity"),
                                        F.col("cost").alias("amount"))
    got = {r.tenant_id: r for r in account_history.account_states(opening.union(events)).collect()}
    for tenant, want in frozen.items():
        row = got[tenant]
        assert (row.status, row.message_count, row.sensor_count) == (want.status, want.message_count, want.sensor_count)
        assert row.amount_due == pytest.approx(want.amount_due, abs=1e-9)


def random_accounts(seed, tenants=12, n=60):
    rng = random.Random(seed)
    make = {"messages": lambda: (rng.randrange(400_000), 0.0), "sensors": lambda: (rng.randrange(-3, 4), 0.0),
            "query": lambda: (0, rng.randrange(1, 3000) / 1000), "topup": lambda: (0, rng.randrange(1, 8) + 0.000123),
            "cycle": lambda: (0, 0.0)}
    data = []
    for tenant in range(tenants):
        weights = [rng.random() + 0.05 for _ in make]
        for _ in range(rng.randrange(1, n)):
            kind = rng.choices(list(make), weights)[0]
            data.append((f"t{tenant}", T0 + datetime.timedelta(days=rng.randrange(30)), len(data), kind, *make[kind]()))
    return data


@pytest.mark.parametrize("seed,seconds", [(1, 10 ** 11), (2, 10 ** 11), (3, 86400), (4, 3600)])
def test_history_equals_the_rules_one_by_one(spark, seed, seconds, monkeypatch):
    monkeypatch.setattr(ordered, "SECONDS", seconds)
    data = random_accounts(seed)
    events = spark.createDataFrame(
        data, "tenant_id string, happened_at timestamp, id long, kind string, quantity long, amount double")
    got = {r.tenant_id: r for r in account_history.account_states(events).collect()}
    assert set(got) == {e[0] for e in data}
    for tenant, row in got.items():
        own = sorted((e for e in data if e[0] == tenant), key=lambda e: (e[1], e[2]))
        same(row, one_by_one(NEW, [(e[3], e[4], e[5], e[2]) for e in own]))
