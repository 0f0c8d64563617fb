"""Usage, cost, budget and query-spend analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import money
from loam.plans.paging import paged_lists
from loam.schemas import PRICES, Prices


def with_query_cost(stats: DataFrame, prices: Prices = PRICES) -> DataFrame:
    units = money.query_units(F.col("processed_bytes"), F.col("cpu_ms"),
                              F.col("peak_mem_bytes"), F.col("wall_ms"))
    return (stats.withColumn("qu", units)
            .withColumn("cost", money.query_cost(F.col("qu"), prices))
            .withColumn("data_points", money.data_points(F.col("qu"))))


def with_live_counts(sensors: DataFrame, live: DataFrame) -> DataFrame:
    """Live message count where there is one, else the stored one."""
    counts = live.select("sensor_id", F.col("message_count").alias("live_count"))
    return (sensors.join(counts, "sensor_id", "left")
            .withColumn("messages", F.coalesce("live_count", "message_count")))


def with_costs(sensors: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Message, storage and total cost of each sensor; expects `messages`."""
    stored = money.stored_bytes(F.col("storage_bytes"), F.col("messages"))
    return (sensors.withColumn("stored_bytes", stored)
            .withColumn("message_cost", money.message_cost(F.col("messages"), prices))
            .withColumn("storage_cost", money.storage_cost(F.col("stored_bytes"), prices))
            .withColumn("total_cost", F.col("message_cost") + F.col("storage_cost")))


def total_messages(sensors: DataFrame) -> DataFrame:
    """Two totals per tenant: live only once any sensor is live, and the row-wise overlay."""
    live, stored = F.sum("live_count"), F.sum("message_count")
    return sensors.groupBy("tenant_id").agg(
        F.when(F.count("live_count") > 0, live).otherwise(stored).alias("dashboard_messages"),
        F.sum("messages").alias("overlay_messages"))


def running_cost(sensors: DataFrame, query_spend: DataFrame) -> DataFrame:
    """Cost of each tenant by source with its share of the grand total."""
    per_tenant = sensors.groupBy("tenant_id").agg(
        F.sum("message_cost").alias("message_cost"), F.sum("storage_cost").alias("storage_cost"))
    spend = query_spend.select("tenant_id", F.col("total_cost").alias("query_cost"))
    joined = per_tenant.join(spend, "tenant_id", "left").fillna({"query_cost": 0.0})
    grand = F.col("message_cost") + F.col("storage_cost") + F.col("query_cost")

    def share(name: str) -> Column:
        part = F.when(F.col("grand_total") > 0, F.col(name) / F.col("grand_total") * 100)
        return F.round(F.coalesce(part, F.lit(0.0)), 1).alias(name.replace("cost", "pct"))
    return joined.withColumn("grand_total", grand).select(
        "*", share("message_cost"), share("storage_cost"), share("query_cost"))


def share_of_total(sensors: DataFrame, value: str) -> DataFrame:
    """Share of each sensor in its tenant's total; totals are combined before the shuffle."""
    totals = sensors.groupBy("tenant_id").agg(F.sum(value).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total") * 100).otherwise(0.0)
    return sensors.join(totals, "tenant_id").withColumn("share_pct", share).drop("_total")


def unbudgeted(sensors: DataFrame, balances: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Cost of sensors without a budget against the tenant's balance."""
    cost = money.message_cost(F.col("messages"), prices)
    spent = sensors.groupBy("tenant_id").agg(
        F.sum(F.when(F.col("budget").isNull(), cost).otherwise(0.0)).alias("unbudgeted_cost"))
    used, balance = F.col("unbudgeted_cost"), F.col("balance")
    level = (F.when((used > balance) & (balance >= 0), "exhausted")
             .when((used >= balance * 0.8) & (used <= balance) & (balance > 0), "low")
             .otherwise("ok"))
    return spent.join(balances, "tenant_id").withColumn("alert", level)


def over_budget(sensors: DataFrame, prices: Prices = PRICES) -> DataFrame:
    cost = money.message_cost(F.col("messages"), prices)
    return (sensors.withColumn("cost", cost)
            .filter((F.col("budget") > 0) & (F.col("cost") >= F.col("budget"))))


def over_budget_names(sensors: DataFrame, page_size: int = 1000) -> DataFrame:
    """Names of exhausted sensors as bounded lists per tenant."""
    return paged_lists(over_budget(sensors), ["tenant_id"], ["sensor_name", "sensor_id"],
                       F.col("sensor_name"), page_size)


def stored_volume(sensors: DataFrame) -> DataFrame:
    stored = money.stored_bytes(F.col("storage_bytes"), F.col("messages"))
    return (sensors.groupBy("tenant_id").agg(F.sum(stored).alias("total_bytes"))
            .withColumn("total_mb", F.col("total_bytes") / money.MB)
            .withColumn("total_gb", F.col("total_bytes") / money.GB))


def storage_usage(sensors: DataFrame, allocations: DataFrame) -> DataFrame:
    """Used space of each sensor against its first allocation."""
    used = money.stored_bytes(F.col("storage_bytes"), F.col("messages"))
    return (sensors.withColumn("used_bytes", used).join(allocations, "sensor_id", "left")
            .withColumn("used_pct", money.used_percent(F.col("used_bytes"), F.col("allocated_gb")))
            .withColumn("band", money.fill_band(F.col("used_pct"))))


def _query_charges(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("reference").startswith("QRY-"))


def _spend() -> list[Column]:
    return [F.count(F.lit(1)).alias("query_count"),
            F.coalesce(F.sum("data_points"), F.lit(0)).cast("double").alias("total_qu"),
            F.coalesce(money.from_micros(F.sum(money.micros(F.col("amount")))), F.lit(0.0))
            .alias("total_cost")]


def query_spend(ledger: DataFrame, sensor_id: str | None = None,
                farm_id: str | None = None) -> DataFrame:
    """Query charges per billing; a sensor id narrows them, else a farm id does."""
    charges = _query_charges(ledger)
    wanted = sensor_id or farm_id
    if wanted:
        charges = charges.filter(F.lower("description").contains(wanted.lower()))
    return charges.groupBy("billing_id").agg(*_spend())


HEAD, HEADS = 4, 1 << 20
"""Letters by which a place in a text is told to begin like some id, and the hashes that may be kept of them."""


def _head(text: Column, at: Column, size: Column) -> Column:
    """Hash of the first letters of the piece of `size` letters at a place, and of its size."""
    return F.pmod(F.xxhash64(F.substring(text, at, F.least(size, F.lit(HEAD))), size), F.lit(HEADS)).cast("int")


def mentions(charges: DataFrame, ids: DataFrame) -> DataFrame:
    """(charge, tenant_id, id): the ids of a charge's tenant that its text contains, letter by letter, whatever their case.

    `charges` has charge, tenant_id and text, `ids` has tenant_id and id, both lower-cased.
    The pieces of a text that are as long as some id meet the ids by an equal join, so
    nothing is compared but what is found, however many ids there are. Only pieces that
    begin like an id of their length are shuffled: those are told by hashes of the first four
    letters, of which there are at most a million, so they are broadcast. A piece that a text
    holds more than once counts at its first place. Ids without letters count nowhere.
    """
    ids = ids.where(F.length("id") > 0).distinct()
    size, at = F.col("_size"), F.col("_at")
    heads = ids.select(_head(F.col("id"), F.lit(1), F.length("id")).alias("_head")).distinct()
    lengths = ids.agg(F.sort_array(F.collect_set(F.length("id")))).scalar()
    pieces = (charges.withColumn("_size", lengths).withColumn("_size", F.explode("_size")).where(size <= F.length("text"))
              .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("text") - size + 1)))
              .withColumn("_head", _head(F.col("text"), at, size)).join(F.broadcast(heads), "_head", "left_semi")
              .withColumn("id", F.substring("text", at, size)).where(F.position("id", "text") == at))
    return pieces.select("charge", "tenant_id", "id").join(ids, ["tenant_id", "id"]).select("charge", "tenant_id", "id")


def query_spend_by_sensor(ledger: DataFrame, sensors: DataFrame, billings: DataFrame) -> DataFrame:
    """Charges of a tenant that mention each of its sensors, or its farm when none does.

    A charge mentions an id if its text contains it, also inside a longer id, whatever its
    case; `_` and `%` are letters like others. Charges belong to the tenant of their
    billing; the same id at two tenants keeps its spend apart.
    """
    owner = billings.select("billing_id", "tenant_id").distinct()
    charges = _query_charges(ledger).select("billing_id", "amount", "data_points", F.lower("description").alias("text")).join(owner, "billing_id")
    # equal texts of a tenant are searched once, and go on as their sums
    texts = charges.groupBy("tenant_id", "text").agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("data_points").alias("qu"), F.sum(money.micros(F.col("amount"))).alias("cost")).alias("charge"))
    ids = sensors.select("tenant_id", F.lower("sensor_id").alias("id")).union(sensors.select("tenant_id", F.lower("farm_id").alias("id")))
    found = mentions(texts, ids).groupBy("tenant_id", "id").agg(
        F.sum("charge.n").alias("query_count"), F.coalesce(F.sum("charge.qu"), F.lit(0)).cast("double").alias("total_qu"),
        F.coalesce(money.from_micros(F.sum("charge.cost")), F.lit(0.0)).alias("total_cost"))

    def spend_of(key: str, prefix: str) -> DataFrame:
        return found.select("tenant_id", F.col("id").alias(f"_{key}"), *[
            F.col(c).alias(f"{prefix}_{c}") for c in ("query_count", "total_qu", "total_cost")])
    joined = sensors.select("tenant_id", "sensor_id", "farm_id", F.lower("sensor_id").alias("_sensor_id"), F.lower("farm_id").alias("_farm_id"))
    joined = (joined.join(spend_of("sensor_id", "own"), ["tenant_id", "_sensor_id"], "left")
              .join(spend_of("farm_id", "farm"), ["tenant_id", "_farm_id"], "left"))
    pick = lambda c, zero: F.coalesce(f"own_{c}", f"farm_{c}", F.lit(zero)).alias(c)
    return joined.select("tenant_id", "sensor_id", "farm_id", pick("query_count", 0),
                         pick("total_qu", 0.0), pick("total_cost", 0.0))


def with_averages(spend: DataFrame) -> DataFrame:
    return (spend.withColumn("avg_cost", F.try_divide("total_cost", "query_count"))
            .withColumn("avg_qu", F.try_divide("total_qu", "query_count")))


def cycle_summary(ledger: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """One row per billing and period: the latest cycle charge and its query usage."""
    is_cycle = F.col("reference").startswith("CYCLE-")
    is_usage = F.col("type") == "usage"
    rank = F.when(is_cycle, F.struct("created_at", "id"))
    cycle = F.max_by(F.struct("amount", "data_points", "created_at"), rank)
    grouped = ledger.groupBy("billing_id", "usage_period").agg(
        cycle.alias("_c"), F.count_if(is_usage).alias("query_items"),
        F.sum(F.when(is_usage, money.micros(F.col("amount"))).otherwise(0)).alias("_query_cost"),
        F.sum(F.when(is_usage, F.col("data_points")).otherwise(0)).alias("_query_qu"))
    messages = F.coalesce("_c.data_points", F.lit(0))
    message_cost = F.round(money.message_cost(messages, prices), 6)
    query_cost = money.from_micros(F.col("_query_cost"))
    amount = F.coalesce("_c.amount", F.lit(0.0))
    return grouped.select(
        "billing_id", "usage_period", amount.alias("cycle_amount"),
        F.col("_c.created_at").alias("cycle_date"), messages.alias("message_count"),
        message_cost.alias("message_cost"), "query_items", query_cost.alias("query_total_cost"),
        F.col("_query_qu").cast("double").alias("query_total_qu"),
        money.storage_residual(amount, message_cost, query_cost).alias("storage_cost"))


def cycle_items(ledger: DataFrame) -> DataFrame:
    """Usage lines of every cycle, oldest first."""
    return (ledger.filter(F.col("type") == "usage")
            .select("billing_id", "usage_period", "id", "created_at", "amount", "data_points",
                    "description")
            .orderBy("billing_id", "usage_period", "created_at", "id"))


def gate_queries(requests: DataFrame, billings: DataFrame) -> DataFrame:
    """Requests with `allowed`: whether their tenant has an active billing."""
    active = billings.filter(F.col("status") == "active").select("tenant_id").distinct().withColumn("_active", F.lit(True))
    return (requests.join(active, "tenant_id", "left")
            .withColumn("allowed", F.coalesce("_active", F.lit(False))).drop("_active"))


def metered_runs(requests: DataFrame, billings: DataFrame, prices: Prices = PRICES) -> DataFrame:
    """Console runs that pass the billing gate, each with its ledger row.

    One job for all runs: gate, units, cost, charge text and period. The history and the
    last statement of a user are views of it (`console.query_history`, `last_statement`).
    """
    run = with_query_cost(gate_queries(requests, billings).filter("allowed"), prices)
    return charges(run, "user_id", "run_at", "qu", "sql")


def charges(stats: DataFrame, *also: str) -> DataFrame:
    """Ledger rows for metered queries; expects qu, cost, data_points, sql and run_at."""
    return stats.select(
        *also, "tenant_id", "query_id", F.lit("usage").alias("type"), F.col("cost").alias("amount"),
        money.charge_text(F.col("qu"), F.col("sql")).alias("description"), "data_points",
        money.period_key(F.col("run_at")).alias("usage_period"))
