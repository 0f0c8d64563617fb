"""Exact Jaccard self-join of shingle sets by index lists with set-relation skipping."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loam.llm.shared import components, in_few_files, let, stored

CHUNK = 1 << 16
COUNTERS = (1 << 21, 1 << 24)
"""Least and most counters of shingles; up to 32 a document between."""
FILTER_BITS = (1 << 22, 1 << 28)
"""Least and most bits of an id filter; 16 to 32 an id between."""
PARITY_BITS = 1024
BLOCK, WEIGHT = 512, 1 << 18
"""Sets, and hashes in their differences, that make a block of a hub."""
WIDE = 2048
KNOWN = 100_000
_known: dict[bytes, int] = {}


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    A to Z count as a to z; words are separated by space and U+0009 to U+000D. A text
    with fewer words has one shingle, the whole sequence; one without words none.
    """
    listed = text.lower().split()
    n = len(listed)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if len(_known) > KNOWN:
        _known.clear()
    for w in set(listed).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, listed), dtype=np.uint64, count=n)
    length = min(k, n)
    mixed = np.full(n - length + 1, length, dtype=np.uint64)
    for j in range(length):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j:n - length + 1 + j]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def sized(wanted: int, bounds: tuple[int, int]) -> int:
    """The power of two that holds so many, within bounds that are powers of two."""
    return min(max(1 << max(0, int(wanted) - 1).bit_length(), bounds[0]), bounds[1])


def counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    raw = hashes.tobytes()
    return (xxhash.xxh3_64_intdigest(raw) - 2 ** 63, xxhash.xxh64_intdigest(raw, 1) - 2 ** 63)


def parities(sets: list[np.ndarray]) -> pa.Array:
    """For every set, whether it has an odd number of hashes in each of some classes, as longs.

    There are 1,024 classes or the power of two from 2 to 4 times the size of a larger
    set; a class is the low bits of the hash, so halving their number joins two halves.
    """
    sizes = np.array([max(PARITY_BITS, 1 << (2 * len(s)).bit_length()) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    low = [(s & np.uint64(m - 1)).astype(np.int64) + e - m for s, m, e in zip(sets, sizes, ends)]
    total = int(ends[-1]) if sets else 0
    odd = np.bincount(np.concatenate(low), minlength=total) & 1 if total else np.zeros(0, dtype=np.int64)
    odd = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]) // 64, pa.int32()), pa.array(odd))


def sketched(docs: DataFrame, k: int, counters: int) -> DataFrame:
    """One row per document (id, n, f1, f2, odd), and how many documents hold the shingles of each counter.

    Counters come as compressed chunks (chunk, counts), a few for each task.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, dtype=np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t or b"", k) for t in batch.column(1).to_pylist()]
                if sets:
                    np.add.at(held, counter(np.concatenate(sets), counters), 1)
                prints = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()),
                     pa.array([b for _, b in prints], pa.int64()), parities(sets), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                    ["id", "n", "f1", "f2", "odd", "chunk", "counts"])
        none = pa.nulls(1, pa.int64())
        for chunk, blob in chunks(held):
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(1, pa.list_(pa.int64())), pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())],
                ["id", "n", "f1", "f2", "odd", "chunk", "counts"])

    return docs.mapInArrow(scan, "id long, n long, f1 long, f2 long, odd array<long>, chunk int, counts binary")


def chunks(held: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of an array of 32-bit counts that are not all zero, compressed."""
    for chunk in range(len(held) // CHUNK):
        part = held[chunk * CHUNK:(chunk + 1) * CHUNK]
        if part.any():
            yield chunk, zlib.compress(part.tobytes(), 1)


def merged_chunks(frame: DataFrame, size: int, combine: np.ufunc = np.add) -> np.ndarray:
    """The arrays that tasks left as (chunk, counts), combined; only the result, of a bounded size, reaches the driver."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, dtype=np.uint64)
        for blob in group["counts"]:
            combine(total, np.frombuffer(zlib.decompress(blob), dtype=np.uint32), out=total)
        total = np.minimum(total, 2 ** 32 - 1).astype(np.uint32)
        return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    held = np.zeros(size, dtype=np.uint32)
    for row in frame.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():
        held[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return held


def frequency_classes(held: np.ndarray) -> np.ndarray:
    """Class of each counter: 0, or more the further it stands out of what chance gives."""
    mean = held.mean()
    often = mean + 6 * np.sqrt(mean) + 2
    return np.where(held > often, 1 + np.floor(np.log2(np.maximum(held / often, 1))), 0).astype(np.uint8)


def postings(docs: DataFrame, classes: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(shingle, id, n, pos) for the prefix of each set in the common order.

    The order is by frequency class, then hash, so common shingles come last. Two sets
    with a Jaccard similarity of num / den share one within their first
    n - ceil(n * num / den) + 1. Sets that a task has seen before are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # a byte for each counter, 16 MB at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = shared.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[tuple[np.ndarray, ...]] = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = shingles(t or b"", k)
                    n = len(s)
                    if not n or i is None or (mark := (i, fingerprint(s)))[1] in seen:
                        continue
                    seen.add(mark[1])
                    size = n + (-n * num // den) + 1
                    of = held[counter(s, len(held))]
                    first = s[np.argsort(of, kind="stable")[:size]] if of.any() else s[:size]
                    out.append((first.view(np.int64), np.full(size, i), np.full(size, n), np.arange(size)))
                if out:
                    s, i, n, p = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.int32())], ["s", "id", "n", "pos"])

    return docs.mapInArrow(scan, "s long, id long, n int, pos int")


def least_overlap(n: Column, m: Column, num: int, den: int) -> Column:
    """Shared shingles that two sets of n and m need."""
    return F.floor((num * (n.cast("long") + m) + num + den - 1) / (num + den))


def possible(a: str, b: str, num: int, den: int) -> Column:
    """Whether two entries of one index list can be the first shingle that a linked pair shares.

    Position skipping: no more can be shared than what is left from the first shared
    shingle on, so blocks of sizes and positions that cannot reach the overlap are passed over.
    """
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    most = F.least(n - i, m - j)
    return (n * num <= m.cast("long") * den) & (m * num <= n.cast("long") * den) & (most >= least_overlap(n, m, num, den))


def reaches(shared: Column, n: Column, m: Column, num: int, den: int) -> Column:
    return den * shared.cast("long") >= num * (n.cast("long") + m - shared)


def differences(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, hub, n, m, diff) of the pairs (a, b) that reach num / den: the sizes, and what only one of both sets holds."""
    left, right = (sets.select(F.col("id").alias(x), F.col("s").alias(f"{x}s")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select(
        F.col("a").alias("id"), F.col("b").alias("hub"), F.size("as").alias("n"), F.size("bs").alias("m"),
        F.concat(F.array_except("as", "bs"), F.array_except("bs", "as")).alias("diff"))
    shared = ((F.col("n") + F.col("m") - F.size("diff")) / 2).cast("long")
    return both.where(reaches(shared, F.col("n"), F.col("m"), num, den))


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many numbers each list of x shares with each of y; a list holds a number once."""
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    sides = []
    flat = [np.concatenate([*z, np.zeros(0, dtype=np.int64)]) for z in (x, y)]
    both = np.intersect1d(*flat)
    for lists, values in zip((x, y), flat):
        at = np.searchsorted(both, values)
        at[at == len(both)] = 0
        hit = both[at] == values if len(both) else np.zeros(len(values), dtype=bool)
        owner, at = np.repeat(np.arange(len(lists)), [len(z) for z in lists])[hit], at[hit]
        by = np.argsort(at, kind="stable")
        sides.append((owner[by], at[by]))
    for start in range(0, len(both), WIDE):
        grids = []
        for lists, (owner, at) in zip((x, y), sides):
            i, j = np.searchsorted(at, (start, start + WIDE))
            grid = np.zeros((len(lists), WIDE), dtype=np.float32)
            grid[owner[i:j], at[i:j] - start] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def tallied(x: pd.DataFrame, y: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(id, links, tied) of two blocks of one hub, or of one block and itself.

    links: copies of the sets linked across (within, if x is y); tied: the smallest id that
    links lead to here. Two sets differ in what one of them alone does not share with the hub.
    """
    sizes = [z["diff"].map(len).to_numpy(dtype=np.int64) for z in (x, y)]
    n, m = (z["n"].to_numpy(dtype=np.int64) for z in (x, y))
    both = n[:, None] + m[None, :]
    shared = (both - sizes[0][:, None] - sizes[1][None, :] + 2 * common(list(x["diff"]), list(y["diff"]))) // 2
    linked = den * shared >= num * (both - shared)
    if x is y:
        np.fill_diagonal(linked, False)
    held = [z["copies"].to_numpy(dtype=np.int64) for z in (x, y)]
    links = [linked @ held[1], held[0] @ linked]
    tied, far = [z["id"].to_numpy(dtype=np.int64).copy() for z in (x, y)], np.iinfo(np.int64).max
    while True:
        down = np.minimum(tied[1], np.where(linked, tied[0][:, None], far).min(axis=0, initial=far))
        if x is y:
            down = np.minimum(down, tied[0])
        up = np.minimum(tied[0], np.where(linked, down[None, :], far).min(axis=1, initial=far))
        if (up == tied[0]).all() and (down == tied[1]).all():
            break
        tied = [np.minimum(up, down)] * 2 if x is y else [up, down]
    out = [pd.DataFrame({"id": z["id"], "links": k, "tied": t})[k > 0] for z, k, t in zip((x, y), links, tied)]
    return out[0] if x is y else pd.concat(out)


def _tally(num: int, den: int):
    """Function of a group: its pairs of blocks, one after another, as sums and ties.

    Rows of side 0 and 1 are sets by their differences to a hub each; one of side 2 is the
    difference between the two hubs, by which side 0 is brought to the hub of side 1.
    """
    def tally(group: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "links": [], "tied": []}, dtype=np.int64)]
        for _, sets in group.groupby(["c", "d", "lo", "hi"]):
            x, y, apart = (sets[sets["side"] == i] for i in range(3))
            if len(x) and (len(y) or sets["c"].iloc[0] == sets["d"].iloc[0]):
                if len(apart) and len(between := apart["diff"].iloc[0]):
                    x = x.assign(diff=[np.setxor1d(own, between, assume_unique=True) for own in x["diff"]])
                out.append(tallied(x, y if len(y) else x, num, den))
        return pd.concat(out)
    return tally


TALLIED = "id long, links long, tied long"


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with c, d, lo, hi and `one` (both sides have one block): those share tasks, the others have their own."""
    pair = F.xxhash64("c", "d")
    return rows.withColumn("bucket", F.when(F.col("one"), F.pmod(pair, F.lit(buckets))).otherwise(-1)) \
        .withColumn("of", F.when(~F.col("one"), F.struct("c", "d", "lo", "hi"))).drop("one").groupBy("bucket", "of")


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def around_hubs(placed: DataFrame, stats: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(id, links, tied): the links between sets of one hub, the hub included, as sums and ties.

    Answers are derived from the hub's: see `tallied`. The sets of a hub are cut into blocks
    and the pairs of blocks dealt out, so a large group is not one task; hubs of one block
    share tasks. No pair of sets leaves a task: a set has a row for each pair of blocks at most.
    """
    rows = placed.join(stats.where("sets > 1").select("c", "blocks"), "c").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.select("*", _every(F.col("blocks")).alias("other"))
    rows = rows.select("c", F.col("c").alias("d"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "id", "n", "copies", "diff", (F.col("blocks") <= 1).alias("one"))
    return _dealt(rows, buckets).applyInPandas(_tally(num, den), TALLIED)


def between_hubs(near: DataFrame, placed: DataFrame, stats: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(id, links, tied): the links between sets of two hubs (c, d, diff, allowed), as sums and ties.

    A set takes part if its own distance to its hub allows a link with one around the other hub.
    """
    own, others = (stats.select(F.col("c").alias(x), F.col("blocks").alias(f"{x}blocks"), F.col("radius").alias(f"{x}radius")) for x in "cd")
    near = near.join(own, "c").join(others, "d").withColumn("one", (F.col("cblocks") <= 1) & (F.col("dblocks") <= 1))
    sets = placed.select(F.col("c").alias("at"), "id", "n", "copies", F.col("diff").alias("own"))

    def side(i: int, x: str, other: str) -> DataFrame:
        rows = near.select("*", F.size("diff").alias("apart")).drop("diff")
        rows = rows.join(sets, F.col(x) == F.col("at")).where(F.abs(F.size("own") - F.col("apart")) <= F.col(f"{other}radius") + F.col("allowed"))
        block, each = F.pmod(F.xxhash64("id"), F.col(f"{x}blocks")), _every(F.col(f"{other}blocks"))
        lo, hi = (block.alias("lo"), each.alias("hi")) if i == 0 else (each.alias("lo"), block.alias("hi"))
        return rows.select("c", "d", lo, hi, F.lit(i).alias("side"), "id", "n", "copies", F.col("own").alias("diff"), "one")

    apart = near.select("*", _every(F.col("cblocks")).alias("lo")).select("*", _every(F.col("dblocks")).alias("hi")).select(
        "c", "d", "lo", "hi", F.lit(2).alias("side"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("copies"), "diff", "one")
    rows = side(0, "c", "d").union(side(1, "d", "c")).union(apart)
    return _dealt(rows, buckets).applyInPandas(_tally(num, den), TALLIED)


def sketch_distance(x: str, y: str) -> Column:
    """At most as many as the shingles that only one of two sets holds, going by their sketches.

    Every class of hashes in which one set has an odd and the other an even number holds
    a difference. Sketches of different length meet at the shorter one.
    """
    xor = lambda p, q: p.bitwiseXOR(q)

    def halved(own: str, other: str) -> Column:
        half = (F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), xor)).otherwise(F.col(own))

    # one halving brings sets of like size together; others are not told apart
    counted = let(F.struct(halved(x, y).alias("p"), halved(y, x).alias("q")), lambda z: F.when(F.size(z["p"]) == F.size(z["q"]), F.aggregate(
        F.zip_with(z["p"], z["q"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, p: t + p)).otherwise(0))
    return counted


def allowed(n: Column, m: Column, num: int, den: int) -> Column:
    """Shingles that only one of two linked sets of n and m may hold; more for larger sets."""
    return F.floor((n + m).cast("long") * (den - num) / (den + num))


def plausible(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that can reach num / den going by their sketches."""
    left, right = (rows.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("odd").alias(f"{x}o")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(sketch_distance("ao", "bo") <= allowed(F.col("an"), F.col("bn"), num, den)).select("a", "b").distinct()


def near_hubs(pairs: DataFrame, stats: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(c, d, reach, allowed) of the pairs of hubs that sets around them may be linked across, going by the hubs' sketches.

    Triangle inequality: linked sets differ by `allowed` at most, and each from its hub by
    its radius at most; so the hubs differ by no more than all of these together.
    """
    sides = [stats.join(sketches.select("id", "odd"), F.col("c") == F.col("id")).select(
        F.col("c").alias(x), F.col("odd").alias(f"{x}o"), F.col("radius").alias(f"{x}r"), F.col("most").alias(f"{x}n")) for x in "cd"]
    both = pairs.join(sides[0], "c").join(sides[1], "d").withColumn("allowed", allowed(F.col("cn"), F.col("dn"), num, den))
    both = both.withColumn("reach", F.col("cr") + F.col("dr") + F.col("allowed"))
    return both.where(sketch_distance("co", "do") <= F.col("reach")).select("c", "d", "reach", "allowed")


def id_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.stack([h >> np.uint64(65 - bits.bit_length()), (h >> np.uint64(7)) & np.uint64(bits - 1)]).astype(np.int64)


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of ids, sized by their number up to 32 MB: lets all of them pass, and few others."""
    ids = stored(ids, "wanted")
    bits = sized(16 * ids.count(), FILTER_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 32, dtype=np.uint32)
        for batch in batches:
            at = id_places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(held, at // 32, np.uint32(1) << (at % 32).astype(np.uint32))
        for chunk, blob in chunks(held):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "counts"])

    return merged_chunks(ids.mapInArrow(mark, "chunk int, counts binary"), bits // 32, np.bitwise_or), bits


def shingle_sets(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(id, s): the sets of at least the documents in pairs (a, b). Texts are not shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held, bits = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                batch = batch.filter(batch.column(0).is_valid())
                places = id_places(batch.column(0).to_numpy(), bits)
                known = shared.value[places // 32] >> (places % 32).astype(np.uint32) & np.uint32(1)
                batch = batch.filter(pa.array(known.all(axis=0)))
                sets = [shingles(t or b"", k).view(np.int64) for t in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "s"])

    return docs.mapInArrow(scan, "id long, s array<long>")


class Joined(NamedTuple):
    members: DataFrame
    """(id, n, rep) of every row; equal sets have one rep, those without shingles or id none."""
    held: DataFrame
    """(rep, copies): how many ids hold the set."""
    tallies: DataFrame
    """(id, links, tied): ids that hold a set linked with that of a rep, in parts to be summed, and reps that links tie it to."""


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> Joined:
    """The links between different sets with a Jaccard similarity of num / den or more, as counts and ties.

    Ids that are not null do not repeat. Exact: every link is found and counted, though no
    pairs are written out. Equal sets become one by fingerprint (128 bits). All sets enter
    index lists by their prefix in an order that puts frequent shingles last; how frequent a
    shingle is comes from counters over all documents. Lists of one set are dropped.

    Set relations save most comparisons. Every set is compared with one hub first: the set
    with the largest part of its prefix in lists is the hub of a list, and a set takes the
    hub of most of its lists; one that is not near it is a hub by itself. Sets of a hub get
    their answers among each other from their differences to it, without lists and without
    whole sets. Lists are joined by hub only, not by set, and skipped where sizes and
    positions of a hub's sets allow no link. Pairs of hubs are ruled out by their sketches,
    then by their whole sets, as far as the radii of their sets allow; what is left is
    answered from the differences between the hubs, like sets of one hub.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    counters = sized(32 * source.count(), COUNTERS)
    scan = stored(sketched(source, k, counters), "sketch")
    rows = scan.where("chunk is null").select("id", "n", "f1", "f2", "odd")
    classes = frequency_classes(merged_chunks(scan.where("chunk is not null").select("chunk", "counts"), counters))
    sketches = rows.where("n > 0 and id is not null").select("id", "n", "odd")
    first = rows.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    members = stored(rows.join(first, ["n", "f1", "f2"], "left").select("id", "n", "rep"), "members")
    held = members.where("rep is not null and id is not null").groupBy("rep").agg(F.count("*").alias("copies"))

    listed = postings(source, classes, k, num, den)
    lists = listed.withColumn("size", F.count("*").over(Window.partitionBy("s"))).where("size > 1")
    lists = stored(lists.join(members.where("rep is not null").select("id", "rep"), "id")
                   .groupBy("s", F.col("rep").alias("id"), "n").agg(F.min("pos").alias("pos")), "lists")
    shown = lists.groupBy("id").agg((F.count("*") / F.max("n")).alias("shown"))
    hubs = lists.join(shown, "id").groupBy("s").agg(
        F.max_by(F.struct("id", "n", "pos"), F.struct("shown", (-F.col("id")).alias("low"))).alias("hub"), F.count("*").alias("size")).where("size > 1")
    near = max(2 * num - den, num // 2)
    star = lists.alias("x").join(hubs.select("s", "hub.*").alias("h"), F.col("x.s") == F.col("h.s")) \
        .where((F.col("x.id") != F.col("h.id")) & possible("x", "h", near, den))
    star = star.groupBy(F.col("x.id").alias("a"), F.col("h.id").alias("b")).agg(F.count("*").alias("times"))
    star = star.groupBy("a").agg(F.max_by("b", F.struct("times", (-F.col("b")).alias("low"))).alias("b"))
    star = stored(in_few_files(plausible(star, sketches, near, den), "a"), "star")
    sets = lambda pairs: stored(in_few_files(shingle_sets(source, pairs, k), "id"), "sets")
    refs = stored(in_few_files(differences(star, sets(star), near, den), "id"), "refs")
    refs = refs.join(refs.select(F.col("hub").alias("id")).distinct(), "id", "left_anti")  # a hub has none itself

    found = lists.groupBy("id").agg(F.max("n").alias("n")).join(refs.select("id", "hub", "diff"), "id", "left")
    placed = stored(found.join(held.select(F.col("rep").alias("id"), "copies"), "id").select(
        "id", F.coalesce("hub", "id").alias("c"), "n", "copies", F.coalesce("diff", F.array().cast("array<long>")).alias("diff")), "placed")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("diff")) / WEIGHT)).alias("blocks")
    stats = stored(placed.groupBy("c").agg(F.count("*").alias("sets"), F.max(F.size("diff")).alias("radius"), F.max("n").alias("most"), blocks), "hubs")
    buckets = max(1, placed.count() // BLOCK)

    parts = lists.join(placed.select("id", "c"), "id").groupBy("s", "c").agg(
        F.max(F.col("n") - F.col("pos")).alias("left"), F.min("n").alias("least"), F.max("n").alias("most"))
    parts = parts.join(parts.groupBy("s").count().where("count > 1").select("s"), "s", "left_semi")
    parts = stored(in_few_files(parts, "s", "c"), "parts")
    x, y = parts.select("s", *[F.col(c).alias(f"x{c}") for c in parts.columns[1:]]), parts.select("s", *[F.col(c).alias(f"y{c}") for c in parts.columns[1:]])
    met = x.join(y, "s").where(
        (F.col("xc") < F.col("yc")) & (F.col("xleast") * num <= F.col("ymost").cast("long") * den) & (F.col("yleast") * num <= F.col("xmost").cast("long") * den)
        & (F.least("xleft", "yleft") >= least_overlap(F.col("xleast"), F.col("yleast"), num, den)))
    close = near_hubs(met.select(F.col("xc").alias("c"), F.col("yc").alias("d")).distinct(), stats, sketches, num, den)
    close = stored(in_few_files(close, "c", "d"), "close")
    whole = sets(close.select(F.col("c").alias("a"), F.col("d").alias("b")))
    one, two = (whole.select(F.col("id").alias(x), F.col("s").alias(f"{x}s")) for x in "cd")
    pairs = close.join(one, "c").join(two, "d").select(
        "c", "d", "allowed", "reach", F.concat(F.array_except("cs", "ds"), F.array_except("ds", "cs")).alias("diff"))
    pairs = stored(in_few_files(pairs.where(F.size("diff") <= F.col("reach")).drop("reach"), "c", "d"), "pairs")
    tallies = around_hubs(placed, stats, buckets, num, den).union(between_hubs(pairs, placed, stats, buckets, num, den))
    return Joined(members, held, stored(in_few_files(tallies, "id"), "tallies"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, n_links): groups linked by a Jaccard similarity of num / den or more.

    All links are found (`jaccard_links`) and the groups are made from them. n_links counts
    the other rows that hold an equal or a linked set.

    Ids are integers. Null or empty texts, and texts without words, have no shingles and
    are linked with nothing, like null ids; each is its own component. Rows that repeat
    an id are told apart by a number of their own and share a component, whatever their
    texts. Empty input gives no rows; other columns are ignored. Texts are read whole.
    Hashes have 64 bits.
    """
    rows, key = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), "id"
    if not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        rows, key = stored(rows.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())), "rows"), "row"
    members, held, tallies = jaccard_links(rows, key, "t", k, num, den)
    ties = tallies.select(F.col("id").alias("a"), F.col("tied").alias("b"))
    if key == "row":
        named = members.join(rows.select("row", F.col("id").alias("name")), F.col("id") == F.col("row"), "left")
        of_name = named.where("rep is not null").groupBy("name").agg(F.min("rep").alias("b"))
        ties = ties.union(named.where("rep is not null").join(of_name, "name").select(F.col("rep").alias("a"), "b"))
    merged = components(ties, "groups")
    others = tallies.groupBy("id").agg(F.sum("links").alias("others")).withColumnRenamed("id", "a")
    counts = held.join(others, F.col("rep") == F.col("a"), "left").select(
        F.col("rep").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = members.join(merged, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("of"), "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    if key == "row":  # rows back to ids; a component is named by its smallest id
        out = out.withColumnRenamed("id", "of").join(rows.select("row", "id"), F.col("of") == F.col("row"), "left")
        least = out.where("id is not null").groupBy(F.col("component_id").alias("group")).agg(F.min("id").alias("least"))
        # those without words have no group but share the id's
        of_id = out.where("id is not null").join(least, F.col("component_id") == F.col("group")).groupBy(F.col("id").alias("name")).agg(F.min("least").alias("component"))
        out = out.join(of_id, F.col("id") == F.col("name"), "left").select("id", "n_shingles", F.col("component").alias("component_id"), "n_links")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")
