"""Hard negatives of anchors, by one selection for all windows of their positives' scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.shared import stored

ROWS, ANCHORS = 8192, 1024
"""Rows and anchors that meet in one group, on average."""
SLICE = 64
"""Anchors whose scores a task holds at once."""


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers kept as doubles, exactly, as longs."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    try:
        return (whole(a) @ whole(b).T).astype(np.int64)
    except OverflowError:
        raise ArithmeticError("an inner product does not fit into a long") from None


def best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, highest first, equal ones by place."""
    at = np.arange(len(values))
    if len(values) > 4 * k:
        at = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    return at[np.argsort(-values[at], kind="stable")[:k]]


def _rows(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    frame = frame.sort_values("id", ignore_index=True)
    return frame, np.frombuffer(b"".join(frame["v"]), dtype="<f8").reshape(len(frame), -1)


def _scored(rows: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple[object, np.ndarray, pd.DataFrame]]:
    """Each anchor with its scores with the rows, which are in order of id."""
    rows, x = _rows(rows)
    anchors, y = _rows(anchors)
    for at in range(0, len(anchors), SLICE):
        for anchor, own in zip(anchors[at:at + SLICE].itertuples(), scores(y[at:at + SLICE], x)):
            yield anchor, own, rows


def nearest_alike(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a group of rows: the k best of each anchor's label, itself and rows of its id left out."""
    def find(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3), dtype=np.int64)]
        if len(rows) and len(anchors):
            for anchor, own, rows in _scored(rows, anchors):  # noqa: B020
                places = np.flatnonzero((rows["label"].to_numpy() == anchor.label) & (rows["id"].to_numpy() != anchor.id))
                places = places[best(own[places], k)]
                out.append(np.stack([np.full(len(places), anchor.anchor), own[places], rows["id"].to_numpy()[places]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["anchor", "score", "id"])
    return find


def best_per_slot(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Combiner: of a group of rows, the k best of other labels in every slot of each anchor.

    Slot j of an anchor holds the scores over its j+1st upper limit up to its jth; the last
    slot ends at the least lower limit.
    """
    def find(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), dtype=np.int64)]
        if len(rows) and len(anchors):
            for anchor, own, rows in _scored(rows, anchors):  # noqa: B020
                upper = np.array(anchor.upper, dtype=np.int64)
                places = np.flatnonzero((own <= upper[0]) & (own >= anchor.least) & (rows["label"].to_numpy() != anchor.label)
                                        & (rows["id"].to_numpy() != anchor.id))
                slots = len(upper) - 1 - np.searchsorted(upper[::-1], own[places])
                for j in range(len(upper)):
                    mine = places[slots == j]
                    mine = mine[best(own[mine], k)]
                    out.append(np.stack([np.full(len(mine), anchor.anchor), np.full(len(mine), j), own[mine], rows["id"].to_numpy()[mine]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["anchor", "slot", "score", "id"])
    return find


def _share(value: str, percent: int, up: bool) -> Column:
    """The least (up) or greatest whole number whose hundredfold reaches or keeps to `percent` times a value from 0 on."""
    return F.expr(f"{value} div 100 * {percent} + ({value} % 100 * {percent} + {99 if up else 0}) div 100")


def hard_negatives(table: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Components are floored to whole numbers after multiplication by `scale`; a score is the
    inner product with the anchor, a long. Higher scores come first, ties by smaller id. An
    anchor's positives are its first rows of the same label; each gets the first rows of
    other labels with a score of `low` to `high` percent of its own, `low` and `high` being
    0 to 100. A negative positive score has no such window; one of 0 has only scores of 0.

    Slot-decomposed selection: the positives' upper limits cut an anchor's scores into
    disjoint slots. Rows and anchors meet in blocks; each block keeps the best of every slot,
    ranks keep the best of all blocks, and merging the slots from the lowest up gives the
    best scores below each upper limit: the windows overlap, but no row is looked at once a
    window. Anchors are replicated to the blocks of rows and rows to those of anchors; no
    side is broadcast by this code, and no pairs leave a block but the best ones.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component
    take no part. Vectors of different lengths do not meet. Rows equal in id, label and
    vector count once; other rows of an anchor's id are neither its positives nor its
    negatives, and several anchors of one id give results each. Empty input, or no anchors,
    gives no rows; other columns are ignored. A score beyond a long is an error.
    """
    v, as_id = F.col(vector_col), F.col(id_col).cast("long")
    fine = as_id.isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) \
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    source = table.where(F.coalesce(fine, F.lit(False))).select(
        as_id.alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), v.cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(3)
            ends = values.offsets.to_numpy() - values.offsets[0].as_py()
            flat = np.floor(scale * values.flatten().to_numpy(zero_copy_only=False)).astype("<f8")
            packed = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["id", "label", "asks", "v"])

    vectors = source.mapInArrow(whole, "id long, label long, asks boolean, v binary").groupBy("id", "label", "v").agg(F.max("asks").alias("asks"))
    vectors = stored(vectors.withColumn("anchor", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("v")), "vectors")
    n, asking = vectors.agg(F.count("*"), F.count_if("asks")).first()
    parts, blocks = -(-n // ROWS) or 1, -(-asking // ANCHORS) or 1
    spread = min(parts * blocks, 4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = ["dim", "part", "block"]
    part = F.pmod(F.xxhash64("id", "label", "v"), F.lit(parts)).alias("part")
    block = F.pmod(F.xxhash64("v", "label", "id"), F.lit(blocks)).alias("block")
    each = lambda count, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    rows = vectors.select("dim", part, each(blocks, "block"), "id", "label", "v").repartition(spread, *met).groupBy(*met)

    def met_by(asked: DataFrame, find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        asked = asked.select("*", block).select("*", each(parts, "part"))
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of their own beside those of the rows
        return rows.cogroup(asked.repartition(spread, *met).groupBy(*met)).applyInPandas(find, schema)

    order = [F.desc("score"), F.asc("id")]
    ranked = lambda frame, by, k: frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    asked = vectors.where("asks").select("dim", "anchor", "id", "label", "v")
    alike = ranked(met_by(asked, nearest_alike(positives), "anchor long, score long, id long"), ["anchor"], positives).where("score >= 0")
    alike = stored(alike.select("anchor", "score", "id", _share("score", high, False).alias("upper"), _share("score", low, True).alias("lower")), "positives")
    limits = alike.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("upper"), F.min("lower").alias("least"))
    found = met_by(asked.join(limits, "anchor"), best_per_slot(negatives), "anchor long, slot long, score long, id long")
    kept = ranked(found, ["anchor", "slot"], negatives)

    # merged from the lowest slot up: what lies in a slot comes before all of the slots below
    item = F.struct((-F.col("score")).alias("less"), "id", "score", "slot")
    slots = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(item)).alias("items"))
    in_slot = lambda j: F.filter("items", lambda x: x["slot"] == j)
    merged, tops = F.slice("items", 1, 0), []
    for j in reversed(range(positives)):
        merged = F.slice(F.concat(in_slot(j), merged), 1, negatives)
        tops.insert(0, merged)
    tops = slots.select("anchor", F.array(*tops).alias("tops"))
    joined = alike.join(limits.select("anchor", "upper").withColumnRenamed("upper", "uppers"), "anchor").join(tops, "anchor") \
        .join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    window = F.filter(F.element_at("tops", F.array_position("uppers", F.col("upper")).cast("int")), lambda x: x["score"] >= F.col("lower"))
    out = joined.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("place", "negative"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
                      "positive_score", F.col("negative.score").alias("negative_score"))
