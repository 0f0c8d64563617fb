"""Joins of values with the intervals that hold them: as equal joins, or totals from a sorted line."""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.plans.ordered import Ordered, last_known, running_sum

LEVEL, CELL = "_level", "_cell"
AT_ONCE = 32
"""Groups that one scan of the line follows."""


def level_of(low: Column, high: Column) -> Column:
    """The power of two that an interval's width does not exceed."""
    return F.ceil(F.log2(high - low)).cast("int")


def interval_join(values: DataFrame, value: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Each value with every interval it lies in: low <= value < high. Columns of both sides.

    An interval is kept at the level of its width, in the one to three cells of that power
    of two that it touches, so long intervals take no more rows than short ones. A value
    asks its one cell at each level that some interval has. Both meet by an equal join on
    (level, cell), which Spark can split where a value is frequent; only these pairs are
    compared. A cell is at most twice as wide as its intervals, so the pairs compared stay
    in proportion to those found unless values gather beside an interval. The levels are an
    aggregate of the intervals, at most one for each exponent of a double.

    Values and ends are compared as doubles. Null or NaN values and ends, and intervals
    without width, hold nothing. Intervals without an end on one side must name a finite
    end beyond all values; an infinite one is an error.
    """
    clash = {LEVEL, CELL} & {*values.columns, *intervals.columns} or set(values.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"columns on both sides or taken: {sorted(clash)}")
    lo, hi, v = (F.col(c).cast("double") for c in (low, high, value))
    wide = _with_width(intervals, low, high).withColumn(LEVEL, level_of(lo, hi))
    size = F.pow(F.lit(2.0), F.col(LEVEL))
    first, last = F.floor(lo / size), F.floor(hi / size)
    cells = F.array_distinct(F.array(first, F.least(F.try_add(first, F.lit(1)), last), last))
    kept = wide.withColumn(CELL, F.explode(cells))
    # An endless interval has a level too, so that it is met and fails in the join, not in this subquery.
    levels = _with_width(intervals, low, high, strict=False).agg(F.sort_array(F.collect_set(level_of(lo, hi)))).scalar()
    asked = (values.where(_is_finite(v))
             .withColumn(LEVEL, levels).withColumn(LEVEL, F.explode(LEVEL))
             .withColumn(CELL, F.floor(v / F.pow(F.lit(2.0), F.col(LEVEL)))))
    return asked.join(kept, [LEVEL, CELL]).where((v >= lo) & (v < hi)).drop(LEVEL, CELL)


def interval_totals(values: DataFrame, value: str, kind: str, intervals: DataFrame, low: str, high: str,
                    group: str, name: str) -> DataFrame:
    """Totals of `interval_join` per (group of intervals, kind of values), without its pairs.

    Returns group, kind, `n` pairs, `names` (different non-null names of intervals that
    hold a value of the kind) and `total` of the values, a value counted for each pair.

    The pairs grow with both sides at once; here all ends and different values lie on one
    sorted line in stretches bounded by rows. Up to a value, the intervals of a group that
    began less those that ended are the ones that hold it: exact counts, and no differences
    of sums. An interval holds a value of a kind if the last one before its end is not
    before its start. Kinds and groups are followed as columns, `AT_ONCE` a scan.
    """
    lo, hi, v = (F.col(c).cast("double") + F.lit(0.0) for c in (low, high, value))  # no negative zero
    ends = _with_width(intervals, low, high).select(
        F.col(group).alias("group"), F.col(name).alias("name"), lo.alias("low"), hi.alias("high"))
    counted = values.where(_is_finite(v)).groupBy(F.col(kind).alias("kind"), v.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    begins = ends.groupBy("group", F.col("low").alias("at")).agg(F.count(F.lit(1)).alias("step"))
    line = (begins.withColumn("what", F.lit(0))
            .unionByName(ends.select("group", "name", "low", F.col("high").alias("at"), F.lit(-1).cast("long").alias("step"),
                                     F.lit(1).alias("what")), allowMissingColumns=True)
            .unionByName(counted.withColumn("what", F.lit(2)), allowMissingColumns=True).withColumn("line", F.lit(0)))
    ordered = Ordered.dealt(line, ["line"], ["at", "what"])
    groups = [r[0] for r in begins.select("group").distinct().collect()] or [None]
    kinds = [r[0] for r in counted.select("kind").distinct().collect()] or [None]
    group_type, kind_type = line.schema["group"].dataType, line.schema["kind"].dataType
    pairs, holders = [], []
    for some_groups, some_kinds in zip_longest(_batches(groups), _batches(kinds), fillvalue=[]):
        held = {f"held_{i}": running_sum(F.when(F.col("group").eqNullSafe(F.lit(g)), F.col("step")))
                for i, g in enumerate(some_groups)}
        last = {f"last_{i}": last_known(F.when((F.col("what") == 2) & F.col("kind").eqNullSafe(F.lit(k)), F.col("at")))
                for i, k in enumerate(some_kinds)}
        scanned = ordered.scan(**held, **last).result()
        if some_groups:
            each = F.inline(F.array(*[F.struct(F.lit(g).cast(group_type).alias("group"), F.col(f"held_{i}").alias("held"))
                                      for i, g in enumerate(some_groups)]))
            pairs.append(scanned.where(F.col("what") == 2).select("kind", "at", "n", each).where("held > 0"))
        if some_kinds:
            each = F.inline(F.array(*[F.struct(F.lit(k).cast(kind_type).alias("kind"), F.col(f"last_{i}").alias("last"))
                                      for i, k in enumerate(some_kinds)]))
            holders.append(scanned.where(F.col("what") == 1).select("group", "name", "low", each).where("last >= low"))
    times = F.col("n") * F.col("held")
    totals = reduce(DataFrame.unionByName, pairs).groupBy("group", "kind").agg(F.sum(times).alias("n"), F.sum(F.col("at") * times).alias("total"))
    named = reduce(DataFrame.unionByName, holders).groupBy("group", "kind").agg(F.count_distinct("name").alias("names"))
    same = F.col("t.group").eqNullSafe(F.col("h.group")) & F.col("t.kind").eqNullSafe(F.col("h.kind"))
    return totals.alias("t").join(named.alias("h"), same).select(
        F.col("t.group").alias(group), F.col("t.kind").alias(kind), "n", "names", "total")


def _is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def _with_width(intervals: DataFrame, low: str, high: str, strict: bool = True) -> DataFrame:
    """Intervals that can hold a value; if `strict`, one without a finite width is an error."""
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    held = intervals.where((lo < hi) & ~F.isnan(hi))
    if not strict:
        return held
    endless = F.raise_error(F.lit(f"an interval from {low} to {high} has no finite width"))
    finite = F.when(hi - lo == float("inf"), endless).otherwise(F.lit(True))
    return held.where(finite)


def _batches(keys: list) -> list[list]:
    return [keys[at:at + AT_ONCE] for at in range(0, len(keys), AT_ONCE)]
