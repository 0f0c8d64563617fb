"""Sensor registry, audit trail, roles, sessions and device snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import records
from loam.plans.ordered import Ordered, last_known, previous
from loam.plans.paging import paged_lists


def status_counts(sensors: DataFrame, keys: list[str]) -> DataFrame:
    return sensors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "error").alias("error"))


def search(sensors: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive containment in any of the columns; null counts as empty."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(text.lower())
    return sensors.filter(hit)


def usable(tokens: DataFrame, now: str) -> DataFrame:
    """Tokens neither used nor expired at `now`."""
    return tokens.filter((F.col("expires_at") > F.lit(now).cast("timestamp")) & ~F.col("used"))


def audit_with_names(audit: DataFrame, users: DataFrame) -> DataFrame:
    name = records.display_name(F.col("first_name"), F.col("email"))
    people = users.select(F.col("user_id").alias("performed_by"), name.alias("performed_by_name"))
    return audit.join(people, "performed_by", "left")


def first_role(roles: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Lower-cased name of each user's first role in a tenant."""
    return (user_roles.join(roles, ["role_id", "tenant_id"])
            .groupBy("tenant_id", "user_id")
            .agg(F.lower(F.min_by("role_name", "role_id")).alias("role_name")))


def replace_role(assigned: DataFrame, updates: DataFrame) -> DataFrame:
    """Every updated (tenant, user) keeps only its new role."""
    kept = assigned.join(updates, ["tenant_id", "user_id"], "left_anti")
    return kept.unionByName(updates.select(*kept.columns))


def keep_newest_token(tokens: DataFrame) -> DataFrame:
    """Unused tokens older than a user's newest one become used."""
    newest = tokens.groupBy("user_id").agg(
        F.max(F.struct("created_at", "token_id")).alias("_newest"))
    older = F.struct("created_at", "token_id") < F.col("_newest")
    return (tokens.join(newest, "user_id").withColumn("used", F.col("used") | older)
            .drop("_newest"))


def active_sessions(sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    live = sessions.filter((F.col("status") == "active")
                           & (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return live.join(users.select("user_id", "tenant_id", "email"), ["user_id", "tenant_id"])


def sensors_of_farms(sensors: DataFrame, farms: DataFrame) -> DataFrame:
    """Sensors tied to a farm by column or by metadata.

    The two possible keys become one array without repeats, so a single equi
    join answers the OR condition and no row is produced twice.
    """
    keys = F.array_distinct(F.array_compact(F.array("farm_id", "metadata_farm_id")))
    tied = sensors.withColumn("_farm", F.explode(keys)).drop("farm_id")
    return tied.join(farms.select(F.col("farm_id").alias("_farm"), "farm_name"), "_farm") \
               .withColumnRenamed("_farm", "farm_id")


def first_allocation(allocations: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("allocated_gb", "storage_id"), F.col("storage_id"))
    return (allocations.groupBy("sensor_id").agg(first.alias("_a"))
            .select("sensor_id", "_a.*"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of `incoming` whose key is not there yet, one per key.

    Of rows that repeat a key the least stays, by the columns in `order`, then by the others in turn.
    """
    ranked = [*order, *[c for c in incoming.columns if c not in (*keys, *order)]]
    first = incoming.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_first")).select(*keys, "_first.*") if ranked else incoming.distinct()
    return first.select(*incoming.columns).join(existing, keys, "left_anti")


def device_snapshot(sensors: DataFrame, page_size: int = 1000) -> DataFrame:
    """Devices of each tenant as pages of (sensor_id, name, status)."""
    device = F.struct("sensor_id", F.col("sensor_name").alias("name"), "status")
    return paged_lists(sensors, ["tenant_id"], ["sensor_id"], device, page_size)


def current_registry(changes: DataFrame) -> DataFrame:
    """State after the change feed; deleted sensors are gone."""
    columns = ["sensor_name", "status", "op", "changed_at"]
    row = F.max_by(F.struct("tenant_id", *columns), F.struct("changed_at", "change_id"))
    return (changes.groupBy("sensor_id").agg(row.alias("_row"))
            .select("sensor_id", "_row.*").filter("op <> 'delete'").drop("op"))


def audit_trail(changes: DataFrame) -> DataFrame:
    """One audit row per change, with the name as it was known at that time."""
    seen = Ordered.of(changes, ["sensor_id"], ["changed_at", "change_id"]).scan(
        _op=previous(F.col("op")), old_name=previous(F.col("sensor_name")),
        old_status=previous(F.col("status")), _name=last_known(F.col("sensor_name")))
    fresh = F.col("_op").isNull() | (F.col("_op") == "delete")
    action = (F.when(F.col("op") == "delete", "deleted")
              .when(fresh, "created")
              .when(F.col("status") != F.col("old_status"), "status_changed")
              .when(F.col("sensor_name") != F.col("old_name"), "renamed")
              .otherwise("updated"))
    return seen.result().select("change_id", "sensor_id", "tenant_id",
                                F.col("_name").alias("sensor_name"), action.alias("action"),
                                "old_name", "old_status", "performed_by",
                                F.col("changed_at").alias("created_at"))


# Audit and event texts of billing suspension and its end.
SUSPENDED_TEXT = "Disconnected: billing auto-suspended — running cost exceeded balance"
RESTORED_TEXT = "Reconnected to network: billing restored after top-up"


def _stamped(sensors: DataFrame, status: str, metadata: Column) -> DataFrame:
    return sensors.withColumn("status", F.lit(status)).withColumn("metadata", metadata)


def suspend(sensors: DataFrame, tenants: DataFrame, performed_by: str = "system") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Active sensors of suspended tenants: new rows, audit rows, event rows."""
    hit = sensors.filter(F.col("status") == "active").join(tenants, "tenant_id", "left_semi")
    flagged = records.with_key(F.col("metadata"), "billing_suspended", F.lit("true"))
    audit = hit.select("tenant_id", "sensor_id", "sensor_name",
                       F.lit("status_changed").alias("action"),
                       F.lit("active").alias("old_status"), F.lit("inactive").alias("new_status"),
                       F.lit("billing_suspended").alias("reason"), F.lit(performed_by).alias("performed_by"))
    details = F.create_map(F.lit("old_status"), F.lit("active"), F.lit("new_status"), F.lit("inactive"),
                           F.lit("reason"), F.lit("billing_suspended"))
    events = hit.select("tenant_id", "sensor_id", F.lit("sensor_suspended").alias("event_type"),
                        F.lit("success").alias("status"), F.lit(SUSPENDED_TEXT).alias("message"), details.alias("details"))
    return _stamped(hit, "inactive", flagged), audit, events


def reactivate(sensors: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sensors that billing switched off, of tenants that paid: new rows and event rows."""
    by_billing = F.try_element_at("metadata", F.lit("billing_suspended")) == "true"
    hit = (sensors.filter((F.col("status") == "inactive") & by_billing)
           .join(tenants, "tenant_id", "left_semi"))
    cleared = records.without_key(F.col("metadata"), "billing_suspended")
    events = hit.select("tenant_id", "sensor_id", F.lit("sensor_reconnected").alias("event_type"),
                        F.lit("success").alias("status"), F.lit(RESTORED_TEXT).alias("message"))
    return _stamped(hit, "active", cleared), events


def step_events(results: DataFrame, steps: list[str]) -> DataFrame:
    """Setup results (map step -> status, message) as connection events."""
    known = F.map_filter("steps", lambda k, v: k.isin(*steps))
    return (results.select("sensor_id", F.explode(known).alias("event_type", "_step"))
            .select("sensor_id", "event_type",
                    records.step_status(F.col("_step.status")).alias("status"),
                    F.col("_step.message").alias("message")))


def hardware_view(sensors: DataFrame, hardware: DataFrame) -> DataFrame:
    """Live hardware fields where known, else the stored metadata."""
    stored = lambda key: F.try_element_at("metadata", F.lit(key))
    memory = records.memory_text(F.col("memory_free_mb"), F.col("memory_total_mb"))
    return (sensors.join(hardware, "sensor_id", "left").select(
        "sensor_id",
        F.coalesce("firmware_version", stored("firmware_version")).alias("firmware"),
        F.coalesce("mac_address", stored("mac_address")).alias("mac"),
        F.coalesce("ip_address", stored("ip_address")).alias("ip"),
        F.coalesce(F.col("battery_level_percent").cast("int").cast("string"),
                   stored("battery_level")).alias("battery"),
        F.coalesce(memory, stored("memory")).alias("memory")))
