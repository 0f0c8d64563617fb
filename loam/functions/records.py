"""Column expressions over people, farms and metadata maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam import schemas


def display_name(first_name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(first_name, F.lit("")),
                      F.split_part(email, F.lit("@"), F.lit(1)))


def actor_name(first_name: Column, user_id: Column) -> Column:
    return F.coalesce(F.nullif(first_name, F.lit("")),
                      F.concat(F.lit("User #"), user_id.cast("string")))


def joined_address(*parts: Column) -> Column:
    """Non-empty parts with a comma, a dash when there are none."""
    text = F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


def lenient_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def overlay(base: Column, updates: Column) -> Column:
    """Merge string maps: a null value leaves the key alone, a blank one removes it."""
    given = F.map_filter(updates, lambda k, v: v.isNotNull())
    trimmed = F.transform_values(given, lambda k, v: F.trim(v))
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(trimmed), k))
    merged = F.map_concat(kept, F.map_filter(trimmed, lambda k, v: v != ""))
    return F.when(F.size(merged) > 0, merged)


def with_key(base: Column, key: str, value: Column) -> Column:
    return F.map_concat(without_key(base, key), F.create_map(F.lit(key), value))


def without_key(base: Column, key: str) -> Column:
    return F.map_filter(base, lambda k, v: k != key)


def days_until(day: Column, now: Column) -> Column:
    return F.ceil((F.unix_timestamp(day.cast("timestamp")) - F.unix_timestamp(now)) / 86400)


def harvest_label(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days <= 14, "soon").otherwise("ok")


def growing_days(crop: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in schemas.GROWING_DAYS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(crop)),
                      F.lit(schemas.DEFAULT_GROWING_DAYS))


def harvest_urgency(days: Column) -> Column:
    return (F.when(days <= 30, "red").when(days <= 60, "orange")
            .when(days <= 90, "amber").otherwise("emerald"))


def season_percent(days: Column) -> Column:
    return F.least(days / 365 * 100, F.lit(100.0))


def history_entries(rows: Column) -> Column:
    """Typed crop history; rows without a year or crops are dropped."""
    filled = F.filter(rows, lambda r: (r["year"] != "") & (r["crops"] != ""))
    return F.transform(filled, lambda r: F.struct(
        r["year"].try_cast("int").alias("year"),
        F.transform(F.split(r["crops"], ","), lambda c: F.trim(c)).alias("crops"),
        F.nullif(r["yield_tons"], F.lit("")).try_cast("double").alias("yield_tons")))


def first_crops(crops: Column, shown: int = 3) -> Column:
    return F.slice(crops, 1, shown)


def hidden_crops(crops: Column, shown: int = 3) -> Column:
    return F.greatest(F.size(crops) - shown, F.lit(0))


def memory_text(free_mb: Column, total_mb: Column) -> Column:
    return F.when(total_mb.isNotNull(),
                  F.concat(F.coalesce(free_mb.cast("string"), F.lit("?")), F.lit("/"),
                           total_mb.cast("string"), F.lit(" MB")))


def step_status(raw: Column) -> Column:
    return F.when(raw == "success", "success").when(raw == "skipped", "pending").otherwise("failed")


def page_count(total: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / per_page)).cast("long")
