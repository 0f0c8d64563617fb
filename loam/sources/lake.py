"""Lake tables: one partitioned readings table, dead letters and per-type views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loam import schemas
from loam.sources.offsets import IDENTITY, OffsetLog

# Folders. Tenant, farm and hour stay ordinary columns: as folders they would leave
# a swarm of tiny files with every micro-batch. Files are sorted by tenant and
# sensor instead, so their row-group statistics prune a tenant's reads.
LAYOUT = ["sensor_type", "event_date"]
CLUSTERING = ["tenant_id", "sensor_id", "event_time"]
ROWS_PER_FILE = 2_000_000
SOURCE_COLUMNS = [("_partition", "int"), ("_offset", "bigint"), ("commit_id", "string")]
SNAPSHOT_DAYS = 7
PARTITIONS_PER_DROP = 500


class Lake:
    def __init__(self, spark: SparkSession, database: str, root: str):
        self.spark, self.database, self.root = spark, database, root.rstrip("/")
        self.readings = f"{database}.readings"
        self.dead_letters = f"{database}.dead_letters"
        self.written: dict[str, tuple[str, Row]] = {}   # by table: the last commit of this writer and its days
        self.offsets = OffsetLog(spark, f"{self.root}/offset_log", self.readings, self.dead_letters)

    def create(self) -> Lake:
        """Create what is missing; existing tables are left alone."""
        run = self.spark.sql
        run(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.root}'")
        columns = ", ".join(f"{name} {kind}" for name, kind in schemas.LAKE_COLUMNS + SOURCE_COLUMNS)
        run(f"CREATE TABLE IF NOT EXISTS {self.readings} ({columns}, sensor_type string, "
            f"event_date date) USING parquet PARTITIONED BY ({', '.join(LAYOUT)}) "
            f"TBLPROPERTIES ('snapshot.max-age-days' = '{SNAPSHOT_DAYS}')")
        run(f"CREATE TABLE IF NOT EXISTS {self.dead_letters} (raw_topic string, _partition int, "
            "_offset bigint, value string, reject_reason string, commit_id string, "
            "arrival_date date) USING parquet PARTITIONED BY (arrival_date)")
        names = ", ".join(name for name, _ in schemas.LAKE_COLUMNS)
        for kind in [*schemas.METRIC_BLOCKS, schemas.UNKNOWN_TYPE]:
            run(f"CREATE OR REPLACE VIEW {self.database}.{kind}_data AS SELECT {names} "
                f"FROM {self.readings} WHERE sensor_type = '{kind}'")
        run(f"CREATE OR REPLACE VIEW {self.database}.sensor_data AS SELECT "
            "event_time AS timestamp, metrics AS payload, sensor_id, tenant_id "
            f"FROM {self.readings}")
        return self

    def add_column(self, table: str, name: str, kind: str) -> None:
        """Add a nullable column unless it is there."""
        if name not in self.spark.table(table).columns:
            self.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({name} {kind})")

    def append(self, rows: DataFrame, commit_id: str, repeated: bool = False, logged: bool = False) -> None:
        """One write for all types and tenants; `rows` should be persisted.

        With `repeated` the commit may have been tried before: rows of it that are
        stored already, found by topic, partition and offset, are left out. `logged`
        says that the caller has announced the commit to `offsets` and will record it.
        """
        self._commit(rows, self.readings, commit_id, repeated, LAYOUT, CLUSTERING, logged)

    def append_dead(self, rows: DataFrame, commit_id: str, repeated: bool = False, logged: bool = False) -> None:
        self._commit(rows, self.dead_letters, commit_id, repeated, ["arrival_date"], IDENTITY, logged)

    def _commit(self, rows: DataFrame, table: str, commit_id: str, repeated: bool,
                layout: list[str], clustering: list[str], logged: bool) -> None:
        day = F.col(layout[-1])
        extent = rows.agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first"),
                          F.max(day).alias("last")).first()
        if not extent.n:
            self.written[table] = commit_id, extent
            return
        if not logged:
            self.offsets.forget()
        stored = rows.sparkSession.table(table)
        if repeated:
            rows = rows.join(_stored_of(stored, day, extent, commit_id), IDENTITY, "left_anti")
        # A small commit gets one file per folder. In a large one the rows of a
        # folder are dealt out evenly, so neither a busy type nor a busy tenant
        # or sensor ends up in a single task.
        pieces = math.ceil(extent.n / ROWS_PER_FILE)
        piece = F.pmod(F.xxhash64(*IDENTITY), F.lit(pieces)).alias("_piece")
        # Copies of a record meet in one partition, so dropping them moves nothing again.
        (rows.withColumn("commit_id", F.lit(commit_id)).select(*stored.columns, piece)
         .repartition(*layout, "_piece").dropDuplicates([*layout, "_piece", *IDENTITY])
         .sortWithinPartitions(*layout, *clustering).drop("_piece")
         .write.insertInto(table))
        self.written[table] = commit_id, extent

    def holds(self, messages: DataFrame, commit_id: str) -> bool:
        """Whether every message of the commit that this writer wrote last is stored.

        They are found by topic, partition and offset in the days the commit wrote, so nothing
        is parsed. False for another commit; a message without a full identity is never found.
        """
        known = []
        for table, day in ((self.readings, "event_date"), (self.dead_letters, "arrival_date")):
            last, extent = self.written.get(table, (None, None))
            if last != commit_id:
                return False
            known.append(_stored_of(messages.sparkSession.table(table), F.col(day), extent, commit_id))
        asked = messages.select(F.col("topic").alias("raw_topic"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))
        return asked.join(known[0].unionByName(known[1]), IDENTITY, "left_anti").isEmpty()

    def expired_partitions(self, table: str, now: str, days: int = SNAPSHOT_DAYS) -> DataFrame:
        """Partitions of a table whose whole day is older than the kept time.

        A reading counts by the day it tells; one without a readable time, and a dead
        letter, by the day it arrived.
        """
        spec = self.spark.sql(f"SHOW PARTITIONS {table}")
        limit = F.date_sub(F.lit(now).cast("date"), days)
        day = F.coalesce(*[F.try_to_date(F.regexp_extract("partition", rf"{name}=([0-9-]{{10}})", 1))
                           for name in ("event_date", "arrival_date")])
        return spec.filter(day < limit)

    def expire(self, now: str, days: int = SNAPSHOT_DAYS) -> int:
        """Drop expired partitions; only catalog entries pass through here, never rows."""
        dropped = 0
        for table in (self.readings, self.dead_letters):
            expired = [r.partition for r in self.expired_partitions(table, now, days).toLocalIterator()]
            for at in range(0, len(expired), PARTITIONS_PER_DROP):
                specs = [", ".join("{}='{}'".format(*part.split("=", 1)) for part in name.split("/"))
                         for name in expired[at:at + PARTITIONS_PER_DROP]]
                self.spark.sql(f"ALTER TABLE {table} DROP "
                               + ", ".join(f"PARTITION ({spec})" for spec in specs))
            dropped += len(expired)
        return dropped


def _stored_of(stored: DataFrame, day: Column, extent: Row, commit_id: str) -> DataFrame:
    """Identities of a commit. Folders outside its days are not listed, row groups of others not read."""
    known = stored.filter(day.isNull() | day.between(F.lit(extent["first"]), F.lit(extent["last"])))
    return known.filter(F.col("commit_id") == commit_id).select(*IDENTITY)


def retained(rows: DataFrame, now: str, days: int = SNAPSHOT_DAYS) -> DataFrame:
    """Rows not older than `days`; on a lake table the bound prunes partitions."""
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    kept = rows.filter(F.col("event_time") >= start)
    if "event_date" in rows.columns:
        kept = kept.filter(F.col("event_date") >= F.date_sub(F.lit(now).cast("date"), days))
    return kept
