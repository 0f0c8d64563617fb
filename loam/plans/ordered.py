"""Running values per key that survive one key holding most of the rows.

A plain window puts every row of a key into one task. Here rows are scanned per key
and stretch of the order (six hours, a block of numbers, or a part of a `RankIndex`). Every stretch is reduced to one row of totals, a window over those rows
gives what each stretch takes over from the ones before, and that is joined back. All
keys go the same way, nothing is computed while the plan is built, and the rows are
shuffled once: the local windows, the totals and the join share one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.plans.ranks import PART, PLACE, RankIndex

SECONDS = 6 * 3600
NUMBERS = 1 << 20
GROUP = "_group"


@dataclass(frozen=True)
class Measure:
    kind: str          # sum | min | last | previous
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Measure:
    return Measure("sum", value, inclusive)


def running_min(value: Column) -> Measure:
    return Measure("min", value)


def last_known(value: Column, inclusive: bool = True) -> Measure:
    """Latest non-null value so far."""
    return Measure("last", value, inclusive)


def previous(value: Column) -> Measure:
    """Value of the row before, null on the first row."""
    return Measure("previous", value, False)


def stretch_of(column: Column, kind: T.DataType) -> Column:
    """A number that never falls along the order and is shared by neighbours."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(column.cast("timestamp")) / SECONDS)
    if isinstance(kind, T.IntegralType):
        return F.floor(column / NUMBERS)
    raise ValueError(f"no stretches of {kind.simpleString()}: name some, or let Ordered.dealt find them")


class Ordered:
    """A frame with a total order inside each key; `order` must end in a unique column."""

    def __init__(self, frame: DataFrame, keys: list[str], order: list[str]):
        self.frame, self.keys, self.order = frame, keys, order

    @classmethod
    def of(cls, frame: DataFrame, keys: list[str], order: list[str], stretch: Column | None = None) -> Ordered:
        """`stretch` may name another non-falling value of the order to cut keys at."""
        cut = stretch if stretch is not None else stretch_of(F.col(order[0]), frame.schema[order[0]].dataType)
        # A struct, so that null keys are equal and one partitioning serves all steps.
        group = F.struct(F.struct(*keys).alias("key"), cut.alias("stretch"))
        return cls(frame.withColumn(GROUP, group), keys, order)

    @classmethod
    def dealt(cls, frame: DataFrame, keys: list[str], order: list[str]) -> Ordered:
        """Stretches bounded by rows, for texts and for bursts at one time: sorts and writes the rows first."""
        rows = RankIndex.build(frame, keys, order).rows
        ordered = cls.of(rows, keys, order, F.col(PART))
        return cls(ordered.frame.drop(PART, PLACE), keys, order)

    def scan(self, **measures: Measure) -> Ordered:
        frame, rank = self.frame, F.struct(*self.order)
        totals = frame.groupBy(GROUP).agg(*[_total(m, rank).alias(n) for n, m in measures.items()])
        before = (Window.partitionBy(f"{GROUP}.key").orderBy(f"{GROUP}.stretch")
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = totals.select(GROUP, *[_combine(m, F.col(n)).over(before).alias(f"_carry_{n}") for n, m in measures.items()])
        base = Window.partitionBy(GROUP).orderBy(*self.order)
        scanned = frame.select("*", *[_over(m, base).alias(f"_local_{n}") for n, m in measures.items()])
        joined = scanned.join(carried, GROUP, "left").select(
            *frame.columns, *[_finish(m, F.col(f"_local_{n}"), F.col(f"_carry_{n}")).alias(n) for n, m in measures.items()])
        return Ordered(joined, self.keys, self.order)

    def result(self) -> DataFrame:
        return self.frame.drop(GROUP)


def _over(m: Measure, base) -> Column:
    if m.kind == "previous":
        return F.lag(F.struct(m.value.alias("v"))).over(base)
    frame = base.rowsBetween(Window.unboundedPreceding, 0 if m.inclusive else -1)
    return _combine(m, m.value).over(frame)


def _combine(m: Measure, value: Column) -> Column:
    if m.kind == "sum":
        return F.sum(value)
    if m.kind == "min":
        return F.min(value)
    return F.last(value, ignorenulls=True)


def _total(m: Measure, rank: Column) -> Column:
    if m.kind == "previous":
        return F.max_by(F.struct(m.value.alias("v")), rank)
    if m.kind == "last":
        return F.max_by(m.value, F.when(m.value.isNotNull(), rank))
    return _combine(m, m.value)


def _finish(m: Measure, local: Column, carried: Column) -> Column:
    if m.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if m.kind == "min":
        return F.least(local, carried)
    merged = F.coalesce(local, carried)
    return merged["v"] if m.kind == "previous" else merged
