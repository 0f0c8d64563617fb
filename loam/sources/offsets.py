"""Which records a lake holds, as runs of offsets.

Offsets are cut into blocks of equal length; a block of a topic partition keeps its runs
(first, last), merged as commits come in. So a batch is checked against a few rows per
block, never against stored records, however long the history is.

A commit is announced before its first row is written and recorded after its last. One that
was announced and not recorded was cut short: what it did store is read from the lake, by
its name and days, before the next commit. Rows that were appended outside the log are
found the same way, by one read of all identities. One writer at a time.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.streaming.snapshots import COMPACT_EVERY, Snapshots

BLOCK = 4096
KEYS = ["raw_topic", "_partition", "block"]
IDENTITY = ["raw_topic", "_partition", "_offset"]
SPANS = (T.StructType().add("raw_topic", "string").add("_partition", "integer")
         .add("block", "long").add("first", "long").add("last", "long"))
_BEGUN = "commit_id string, since date, until date"


def in_block(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("_offset") / BLOCK))


def merged(spans: DataFrame) -> DataFrame:
    """Runs that touch or overlap made one; a window holds the runs of one block."""
    window = Window.partitionBy(*KEYS).orderBy("first", "last")
    reach = F.max("last").over(window.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach >= F.col("first") - 1, 0).otherwise(1)
    run = F.sum("_begins").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return (spans.select(*KEYS, "first", "last").distinct().withColumn("_begins", begins).withColumn("_run", run)
            .groupBy(*KEYS, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run"))


def spans(rows: DataFrame) -> DataFrame:
    """Runs of the offsets of records; a record without a full identity is in none."""
    known = in_block(rows.select(*IDENTITY).dropna())
    return merged(known.select(*KEYS, F.col("_offset").alias("first"), F.col("_offset").alias("last")))


class OffsetLog(Snapshots):
    def __init__(self, spark: SparkSession, path: str, readings: str, dead_letters: str):
        super().__init__(spark, path, SPANS, KEYS, merged)
        self.tables = {readings: "event_date", dead_letters: "arrival_date"}
        self.open = False   # rows may come in outside the log, and it says so

    def begin(self, rows: DataFrame, commit_id: str, since: date | None, until: date | None) -> DataFrame | None:
        """Announces a commit; returns those of its records that the lake does not hold.

        `since` and `until` are the first and last day of its rows. None where the lake holds
        no record of the commit, so that nothing has to be left out.
        """
        self._mend()
        self.open = False
        begun = self.spark.createDataFrame([(commit_id, since, until)], _BEGUN).coalesce(1)
        begun.write.mode("overwrite").parquet(f"{self.path}/begun/number={self.last() + 1}")
        held = self.unmerged()
        block = [F.col(f"b.{k}") == F.col(f"h.{k}") for k in KEYS]
        overlap = [F.col("b.first") <= F.col("h.last"), F.col("b.last") >= F.col("h.first")]
        if spans(rows).alias("b").join(held.alias("h"), [*block, *overlap], "left_semi").isEmpty():
            return None
        within = F.col("b._offset").between(F.col("h.first"), F.col("h.last"))
        return in_block(rows).alias("b").join(held.alias("h"), [*block, within], "left_anti").drop("block")

    def finish(self, rows: DataFrame) -> None:
        """Records all records of the announced commit."""
        number = self.last() + 1
        self.write(spans(rows), number)
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            self.compact()
            self.vacuum()
            self._delete([f"{kind}/number={n}" for kind in ("begun", "open") for n in self._complete(kind) if n <= number])

    def forget(self) -> None:
        """Says that rows may be stored which are not recorded; the next `begin` looks for them."""
        number = self.last() + 1
        if not self.open and number > 0 and number not in self._complete("open"):
            self.spark.createDataFrame([], _BEGUN).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/open/number={number}")
        self.open = True

    def _mend(self) -> None:
        """Records what a commit that was cut short has stored, or all that is stored."""
        number = self.last() + 1
        if number == 0 or number in self._complete("open"):
            self.write(spans(self._stored(None)), number)
        elif number in self._complete("begun"):
            commit = self.spark.read.schema(_BEGUN).parquet(f"{self.path}/begun/number={number}").first()
            self.write(spans(self._stored(commit)), number)

    def _stored(self, commit) -> DataFrame:
        parts = []
        for table, day in self.tables.items():
            self.spark.catalog.refreshTable(table)  # a stream writes in a session of its own
            rows = self.spark.table(table)
            if commit:
                rows = rows.filter(F.col("commit_id") == commit.commit_id)
                if commit.since is not None:  # folders of other days are not listed
                    rows = rows.filter(F.col(day).isNull() | F.col(day).between(F.lit(commit.since), F.lit(commit.until)))
            parts.append(rows.select(*IDENTITY))
        return parts[0].unionByName(parts[1])
