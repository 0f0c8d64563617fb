"""A table kept up by micro-batches: hash-bucketed snapshot, deltas since, compaction.

Every micro-batch writes its rows as a delta of its own, which a repeated batch replaces.
Compaction merges the deltas into new files of the buckets they touch and then adds one
manifest: one small file, under the number of the last delta it holds, that names the version
of every bucket. Readers go by the newest complete manifest, so a writer that is lost before the manifest is
there changes nothing, and what it had written is written again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
COMPACT_EVERY = 64
_BATCH, _BUCKET = "_batch", "_bucket"
_MANIFEST = f"{_BUCKET} int, version long"


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the row of the latest batch of each key; a batch has one row per key."""
    def merge(rows: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in rows.columns if c not in (*keys, _BATCH)])
        return rows.groupBy(*keys).agg(F.max_by(row, F.col(_BATCH)).alias("_row")).select(*keys, "_row.*")
    return merge


class Snapshots:
    """Rows of `schema` merged by key.

    `merge` takes rows with their batch number (those of a snapshot come before all others)
    and returns what is kept of each key. It must give the same whether rows are merged at
    once or in parts. Null keys are equal to each other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str],
                 merge: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.merge = merge or newest(keys)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Keeps the rows of a micro-batch, in place of those an earlier try of it left."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(_BUCKET)
        (rows.select(*self.schema.names, bucket).write.mode("overwrite").parquet(f"{self.path}/deltas/{_BATCH}={batch:d}"))

    def read(self) -> DataFrame:
        """What is kept now: one snapshot and the deltas since."""
        return self.merge(self.unmerged()).select(*self.schema.names)

    def unmerged(self) -> DataFrame:
        """The rows that `read` merges, with their batch."""
        upto, versions = self.manifest()
        deltas = self._deltas(upto, max(self._batches(), default=upto)).drop(_BUCKET)
        return self._rows(versions).unionByName(deltas)

    def last(self) -> int:
        """Number of the last micro-batch that is kept, -1 before the first."""
        return max([-1, *self._complete("manifests")[-1:], *self._batches()[-1:]])

    def compact(self) -> int:
        """Merges the deltas into the buckets they touch; returns how many were rewritten."""
        upto, versions = self.manifest()
        last = max(self._batches(), default=upto)
        if last <= upto:
            return 0
        deltas = self._deltas(upto, last)
        touched = {r[0] for r in deltas.select(_BUCKET).distinct().collect()}  # at most `buckets` numbers
        if touched:
            old = self._rows({b: v for b, v in versions.items() if b in touched})
            merged = self.merge(old.unionByName(deltas.drop(_BUCKET))).select(*self.schema.names)
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            (merged.withColumn(_BUCKET, bucket).repartition(_BUCKET).sortWithinPartitions(_BUCKET, *self.keys)
             .write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/snapshots/version={last}"))
        self._publish(last, versions | dict.fromkeys(touched, last))
        return len(touched)

    def vacuum(self) -> None:
        """Deletes deltas and versions that neither of the two newest manifests names.

        A reader that started before the last compaction still finds its files.
        """
        done = self._complete("manifests")[-2:]
        if len(done) < 2:
            return
        named = set().union(*[self._versions(upto).values() for upto in done])
        self._delete([f"deltas/{_BATCH}={b}" for b in self._batches() if b <= done[0]]
                     + [f"manifests/upto={m}" for m in self._complete("manifests") if m < done[0]]
                     + [f"snapshots/version={v}" for v in self._complete("snapshots") if v < done[1] and v not in named])

    def manifest(self) -> tuple[int, dict[int, int]]:
        """Last batch of the newest snapshot (-1: none) and the version of each of its buckets."""
        done = self._complete("manifests")
        return (done[-1], self._versions(done[-1])) if done else (-1, {})

    def _deltas(self, after: int, last: int) -> DataFrame:
        """Only the folders of these batches are listed and read."""
        schema = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType()), T.StructField(_BATCH, T.LongType())])
        paths = [f"{self.path}/deltas/{_BATCH}={b}" for b in self._batches() if after < b <= last]
        return self._read(paths, schema, "deltas")

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/snapshots/version={v}/{_BUCKET}={b}" for b, v in sorted(versions.items()) if self._has(f"snapshots/version={v}/{_BUCKET}={b}")]
        return self._read(paths, self.schema, "snapshots").withColumn(_BATCH, F.lit(-1).cast("long"))

    def _read(self, paths: list[str], schema: T.StructType, base: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{base}").parquet(*paths).select(*schema.names)

    def _versions(self, upto: int) -> dict[int, int]:
        """Version of each bucket that has rows, by one manifest: at most a row per bucket."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/upto={upto}").collect()
        return {r[_BUCKET]: r.version for r in rows if r[_BUCKET] is not None}

    def _publish(self, upto: int, versions: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(versions.items()), _MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/upto={upto}")

    def _batches(self) -> list[int]:
        return self._complete("deltas")

    def _complete(self, below: str) -> list[int]:
        """Numbers of the folders that were written to the end, which Spark marks with a file."""
        return sorted(int(n.split("=")[1]) for n in self._names(below) if self._has(f"{below}/{n}/_SUCCESS"))

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, below: str) -> bool:
        return self._files().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}"))

    def _names(self, below: str) -> list[str]:
        """Numbered folders below one; as many as there are batches since the last vacuum."""
        if not self._has(below):
            return []
        found = self._files().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}"))
        return [s.getPath().getName() for s in found if "=" in s.getPath().getName()]

    def _delete(self, below: Iterable[str]) -> None:
        for name in below:
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def upserts(table: Snapshots, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Sink for update-mode rows: a delta each micro-batch, merged every so many of them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact()
            table.vacuum()
    return write
