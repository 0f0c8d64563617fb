"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.shared import components, stored

RADII = (1.0, 0.5, 0.25)
"""Nominal radii of a tree's levels below its root, halving; bounds use the true radii."""
SLACK = 1e-5
"""What float32 products may be off, besides rounding in proportion to the length of vectors; whatever lies closer to a bound is looked at in double precision."""
MOST_ROWS = 4096
"""Rows of a block at most, however short its vectors: building its tree takes their distances from each other."""
TILE, TILES = 16, 8
"""Blocks of a tile at most, and tiles that there should be at least: a task meets two tiles at a time."""
AT_ONCE = 1 << 18
"""Products of a pair of blocks that are held at once."""
AXES = 16
"""Directions in which rows are compared first; the lengths of what is left of them bound the rest of their products."""


def units(data: bytes | np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision of stored float32 vectors."""
    x = np.frombuffer(data, dtype="<f4").reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def cover(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the rows in which every tree node is one stretch, and the nodes by level.

    A level is an array of (start, end) in that order, the first row of a stretch being
    the node's centre. Centres of a level lie further apart than its radius within their
    parent; a parent's centre is the centre of one of its children.
    """
    y = x.astype(np.float32)
    far = y @ y.T  # turned into distances in place: there are MOST_ROWS squared
    far *= -2
    far += 2
    np.sqrt(np.maximum(far, 0, out=far), out=far)
    stretches, levels = [np.arange(len(x))], []
    for radius in RADII:
        finer = []
        for rows in stretches:
            if len(rows) == 1:
                finer.append(rows)
                continue
            left = np.ones(len(rows), dtype=bool)
            near = far[np.ix_(rows, rows)] <= radius if len(rows) < len(x) else far <= radius
            for i in range(len(rows)):
                if left[i]:
                    own = near[i] & left
                    own[i] = False
                    left &= ~own
                    left[i] = False
                    finer.append(np.concatenate([rows[i:i + 1], rows[own]]))
        stretches = finer
        levels.append(np.array([len(s) for s in finer]))
    nodes = []
    for sizes in levels:
        ends = np.cumsum(sizes)
        nodes.append(np.stack([ends - sizes, ends], axis=1))
    return np.concatenate(stretches), nodes


class Tree:
    """Vectors of one block in tree order; by level from the root to the rows the starts of nodes, their true radii and where their children begin and end.

    A level that hardly merges nodes of the next one is passed over: it repeats that one.
    """

    def __init__(self, v: np.ndarray, first: np.ndarray, axes: np.ndarray):
        """first: the coarsest level below the root on which a row is a node's centre; axes: orthogonal unit vectors, one a row."""
        self.v, self.norm = v, np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
        x = self.units(slice(None))
        self.y = x.astype(np.float32)
        z = x @ axes.T
        self.z = np.column_stack([z, np.sqrt(np.maximum(1 - (z * z).sum(axis=1), 0))]).astype(np.float32)
        starts = [np.zeros(1, dtype=np.int64), *(np.flatnonzero(first <= k) for k in range(len(RADII))), np.arange(len(v))]
        for k in range(len(RADII), 0, -1):
            if 4 * len(starts[k]) > 3 * len(starts[k + 1]):
                starts[k] = starts[k + 1]
        self.levels = []
        for start, finer in zip(starts, [*starts[1:], starts[-1]]):
            sizes = np.diff(start, append=len(v))
            radius = np.maximum.reduceat(distance((x * np.repeat(x[start], sizes, axis=0)).sum(axis=1)), start)
            self.levels.append((start, np.where(sizes > 1, radius, 0).astype(np.float32), np.searchsorted(finer, start), np.searchsorted(finer, start + sizes)))

    def units(self, rows: np.ndarray | slice) -> np.ndarray:
        """Unit vectors of some rows in double precision."""
        return self.v[rows].astype(np.float64) / self.norm[rows]


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def linked(a: Tree, b: Tree, least: float) -> Pairs:
    """Positions of all pairs of rows of two blocks with a cosine of `least` or more, in parts of bounded size.

    Both trees are descended together. A pair of nodes goes no further if its centres lie
    further apart than both radii and the threshold's distance allow. Where few pairs of
    nodes go no further, all their children are multiplied out instead of pair by pair.
    Rows are the last level; those next to the threshold are compared in double precision.
    Many rows are first compared along some axes, with the most that the rest of them can
    add. Pairs go down in parts, so what is held at once does not depend on their number.
    """
    dim, both = a.v.shape[1], (a, b)
    tau, slack = np.float32(distance(np.array(least))), SLACK + 1.2e-7 * dim
    most = max(256, (1 << 21) // dim)  # pairs whose vectors are set side by side

    def kept(c: np.ndarray, far: np.ndarray | np.float32) -> np.ndarray:
        return np.flatnonzero(c >= 1 - far * far / 2 - slack)

    def same(level: int, other: int) -> bool:
        return all(t.levels[level][0] is t.levels[other][0] for t in both)

    def checked(c: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows with their cosines those that are linked."""
        own = c >= least + slack
        near = np.flatnonzero(~own)
        for k in range(0, len(near), most):
            at = near[k:k + most]
            own[at] = np.einsum("ij,ij->i", a.units(p[at]), b.units(q[at])) >= least
        return p[own], q[own]

    def below(tree: Tree, level: int, nodes: np.ndarray) -> np.ndarray:
        """All children of some nodes."""
        _, _, first, end = tree.levels[level]
        n = (end - first)[nodes]
        return np.repeat(first[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def multiplied(level: int, i: np.ndarray, j: np.ndarray) -> Pairs:
        """Links below all pairs of some nodes of a level. Single rows and nodes are told apart, as rows need one bound only."""
        last = same(level, -1)
        while not last and same(level, level + 1):
            level += 1
        (la, ra, fa, ea), (lb, rb, fb, eb) = a.levels[level], b.levels[level]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = [[(True, k[r[k] == 0]), (False, k[r[k] > 0])] for r, k in ((ra, i), (rb, j))]
        for alone, m, n in [(s and t, m, n) for s, m in kinds[0] for t, n in kinds[1] if len(m) and len(n)]:
            x, y, step = a.y[la[m]], b.y[lb[n]], max(1, AT_ONCE // len(n))
            short = alone and len(m) * len(n) > AT_ONCE // 4 and a.z.shape[1] < dim
            if short:
                xz, yz = a.z[la[m]], b.z[lb[n]].T
            for k in range(0, len(m), step):
                if short:
                    at = kept(xz[k:k + step] @ yz, tau)
                    short = len(at) <= most // 16  # else the axes tell too little here
                if short:
                    p, q = np.divmod(at, len(n))
                    c = np.einsum("ij,ij->i", x[k + p], y[q])
                    own = kept(c, tau)
                    c, p, q = c[own], m[k + p[own]], n[q[own]]
                else:
                    c = x[k:k + step] @ y.T
                    at = kept(c, tau if alone else ra[m[k:k + step], None] + (rb[n] + tau))
                    p, q = np.divmod(at, len(n))
                    c, p, q = c.ravel()[at], m[k + p], n[q]
                if last:
                    yield checked(c, p, q)
                elif 32 * ((ea - fa)[p] * (eb - fb)[q]).sum() > (ea - fa)[m[k:k + step]].sum() * (eb - fb)[n].sum():
                    yield from multiplied(level + 1, below(a, level, m[k:]), below(b, level, n))
                    break
                else:
                    held.append((p, q))
                    if sum(len(p) for p, _ in held) >= most:
                        yield from descend(level, *map(np.concatenate, zip(*held)))
                        held = []
        if held:
            yield from descend(level, *map(np.concatenate, zip(*held)))

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> Pairs:
        """Links below pairs of nodes of a level that is not the last."""
        while same(level, level + 1):
            level += 1
        (_, _, ca, ea), (_, _, cb, eb) = a.levels[level], b.levels[level]
        (la, ra, *_), (lb, rb, *_) = a.levels[level + 1], b.levels[level + 1]
        n = (ea - ca)[i] * (eb - cb)[j]
        few = n <= min(most, 2048)
        for s, t in zip(i[~few], j[~few]):
            yield from multiplied(level + 1, np.arange(ca[s], ea[s]), np.arange(cb[t], eb[t]))
        i, j, n = i[few], j[few], n[few]
        ends = np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], most)), len(ends))) if len(i) else []
        for s, t in zip(cuts[:-1], cuts[1:]):
            pair = np.repeat(np.arange(s, t), n[s:t])
            nth, nb = np.arange(len(pair)) - (ends - n)[pair] + (ends - n)[s], (eb - cb)[j[pair]]
            p, q = ca[i[pair]] + nth // nb, cb[j[pair]] + nth % nb
            c = np.einsum("ij,ij->i", a.y[la[p]], b.y[lb[q]])
            own = kept(c, ra[p] + rb[q] + tau)
            if same(level + 1, -1):
                yield checked(c[own], p[own], q[own])
            elif len(own):
                yield from descend(level + 1, p[own], q[own])

    yield from multiplied(0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))


def tied(group: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The group of every row, named by one of its rows, after the rows of p and q have been tied."""
    apart = group[p] != group[q]
    if not apart.any():
        return group
    names, at = np.unique(np.concatenate([group[p[apart]], group[q[apart]]]), return_inverse=True)
    a, b = np.split(at, 2)
    low = np.arange(len(names))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (before == low).all():
            break
    now = np.arange(len(group))
    now[names] = names[low]
    return now[group]


def answers(trees: list[Tree], pairs: Iterator[tuple[int, int]], ids: np.ndarray, copies: np.ndarray, least: float) -> pa.Table:
    """Of some pairs of blocks: for every row with links their number and the smallest id it is tied to here. The rows of the blocks follow one another."""
    ends = np.cumsum([len(t.v) for t in trees])
    links, group = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for s, t in pairs:
        one, two = (slice(ends[k] - len(trees[k].v), ends[k]) for k in (s, t))
        for p, q in linked(trees[s], trees[t], least):
            if s == t:
                p, q = p[p < q], q[p < q]
            links[one] += np.bincount(p, copies[two][q], len(trees[s].v)).astype(np.int64)
            links[two] += np.bincount(q, copies[one][p], len(trees[t].v)).astype(np.int64)
            group = tied(group, p + one.start, q + two.start)
    low = ids.copy()
    np.minimum.at(low, group, ids)
    hit = links > 0
    return pa.table({"id": ids[hit], "links": links[hit], "tied": low[group][hit]})


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
                    block_bytes: int = 1 << 20, most_pivots: int = 512) -> DataFrame:
    """(id, n_links, component_id, kept): links are all pairs with a cosine of `least` or more, exactly.

    Cosines are of double precision. Equal vectors become one with a count. The others
    are routed to the nearest of some pivots (those with the least hash, at most
    `most_pivots`), which form the tree's upper level, cells too large for one block being
    dealt into several. Every block holds about `block_bytes` of vectors, MOST_ROWS at most,
    and a cover tree of its own below. Pairs of cells that lie too far apart by their true
    radii are dropped; every other pair of blocks gets a dual traversal. Blocks meet in
    pairs of tiles, so a vector is shuffled once for each tile that its cell may have
    links in, as a row of its own, and a task holds two tiles. It returns sums and one
    tie for each row, not pairs, so a group of near copies makes no more rows than it has.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, as do those of different lengths with each other. Rows with equal ids are
    told apart by their vectors; their components are the same. Null ids are left out of
    links. Empty input gives no rows; other columns are ignored.
    """
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) \
        & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")  # without those of null lists
            none = lists.is_null().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            vs = [None if x else flat[a:b].tobytes() for x, a, b in zip(none, np.append(0, ends), ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vs, pa.binary())], ["id", "v"])

    rows = stored(rows.mapInArrow(packed, "id long, v binary").withColumn("key", F.sha2("v", 256)), "vectors")
    classes = rows.where("v is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = stored(rows.select("id", "key").join(classes, "key", "left"), "members")
    mine = rows.where("v is not null").join(classes.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("id") == F.col("rep"))) \
        .select("rep", "key", "copies", "v").dropDuplicates(["key"])
    dims = {r["dim"]: r["n"] for r in classes.join(rows.where("v is not null"), "key").groupBy((F.octet_length("v") / 4).cast("int").alias("dim"))
            .agg(F.countDistinct("key").alias("n")).collect()}  # one row for each length of vectors
    result = None
    for dim, n in dims.items():
        own = mine.where(F.octet_length("v") == 4 * dim)
        got = _block_links(own, dim, n, least, min(MOST_ROWS, max(256, block_bytes // (4 * dim))), most_pivots)
        result = got if result is None else result.union(got)
    if result is None:
        result = table.sparkSession.createDataFrame([], "id long, links long, tied long")
    result = stored(result, "answers")
    summed = result.groupBy("id").agg(F.sum("links").alias("links"))
    # the same id with several vectors is one node
    same = members.where("rep is not null and id <> rep").groupBy("id").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1") \
        .select("id", F.explode("reps").alias("tied"))
    ties = components(result.select(F.col("id").alias("a"), F.col("tied").alias("b"))
                      .union(same.select("id", "tied")), "ties")
    out = members.join(summed.withColumnsRenamed({"id": "r"}), F.col("rep") == F.col("r"), "left") \
        .join(ties, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _block_links(own: DataFrame, dim: int, n: int, least: float, size: int, most_pivots: int) -> DataFrame:
    """(id, links, tied) of distinct vectors of one length, one row for each pair of tiles a vector has links in."""
    spark = own.sparkSession
    size = min(size, max(256, -(-n // TILES)))  # a small table is dealt out too
    wanted = min(most_pivots, max(1, n // size))
    pivots = units(b"".join(r["v"] for r in own.orderBy(F.xxhash64("key"), "key").select("v").limit(wanted).collect()), dim)
    shared = spark.sparkContext.broadcast(pivots)  # at most `most_pivots` vectors
    axes = np.linalg.svd(pivots, full_matrices=False)[2][:AXES]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(b"".join(batch.column(2).to_pylist()), dim)
                cosine = x @ shared.value.T
                cell = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance(cosine[np.arange(len(cell)), cell]))],
                    ["rep", "copies", "v", "cell", "far"])

    routed = stored(own.select("rep", "copies", "v").mapInArrow(route, "rep long, copies long, v binary, cell int, far double"), "routed")
    stats = {r["cell"]: (-(-r["n"] // size), r["far"], r["n"]) for r in
             routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # one row a pivot
    chunks = F.element_at(F.create_map(*[F.lit(x) for c, (k, *_) in stats.items() for x in (c, k)]), F.col("cell"))
    split = routed.withColumn("chunk", F.pmod(F.xxhash64("rep", "v"), chunks).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        order, nodes = cover(units(b"".join(group["v"]), dim))
        first = np.full(len(order), len(nodes))
        for k in reversed(range(len(nodes))):
            first[nodes[k][:, 0]] = k
        return group.iloc[order].assign(place=np.arange(len(order)), first=first)[["cell", "chunk", "place", "first", "rep", "copies", "v"]]

    rows = "cell int, chunk int, place int, first int, rep long, copies long, v binary"
    blocks = stored(split.groupBy("cell", "chunk").applyInPandas(build, rows), "blocks")
    tau = float(distance(np.array(least)))
    apart = distance(pivots @ pivots.T)
    far = np.array([stats[c][1] if c in stats else -np.inf for c in range(len(pivots))])
    near = apart <= far[:, None] + far + tau + 1e-9
    near[np.diag_indices(len(far))] = far >= 0
    width, spans, cells = max(size, min(TILE * size, -(-n // TILES))), {}, []
    begin = 0
    for c, (k, _, count) in stats.items():  # cells lie one after the other; a tile is a stretch of them
        spans[c] = (begin, begin // width, (begin + (k - 1) * count // k) // width)
        begin += count
    for c, (k, _, count) in stats.items():
        met: list[list[int]] = []
        for _, s, t in sorted(spans[d] for d in np.flatnonzero(near[c]).tolist()):
            if met and s <= met[-1][1] + 1:
                met[-1][1] = max(t, met[-1][1])
            else:
                met.append([s, t])
        cells += [(c, k, count, spans[c][0], s, t) for s, t in met]
    cells = F.broadcast(spark.createDataFrame(cells, "cell int, k long, count long, begin long, s long, t long"))  # at most most_pivots squared / 2
    tile = F.expr(f"(begin + chunk * count div k) div {width}")
    both = blocks.join(cells, "cell").withColumn("tile", tile).withColumn("other", F.explode(F.sequence("s", "t"))) \
        .select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", *blocks.columns)

    def traverse(table: pa.Table) -> pa.Table:
        column = {c: table[c].to_numpy() for c in ("tile", "cell", "chunk", "place", "first", "rep", "copies")}
        order = np.lexsort([column[c] for c in ("place", "chunk", "cell")])
        to, v, at = np.argsort(order), np.empty((len(order), dim), dtype="<f4"), 0
        for part in table["v"].chunks:
            v[to[at:at + len(part)]] = np.frombuffer(b"".join(part.to_pylist()), "<f4").reshape(-1, dim)
            at += len(part)
        column = {c: x[order] for c, x in column.items()}
        starts = np.flatnonzero(column["place"] == 0)
        trees = [Tree(v[s:t], column["first"][s:t], axes) for s, t in zip(starts, [*starts[1:], len(v)])]
        of, cell, alone = column["tile"][starts], column["cell"][starts], table["i"][0] == table["j"][0]
        pairs = ((x, y) for x in range(len(trees)) for y in range(x, len(trees)) if near[cell[x], cell[y]] and (alone or of[x] != of[y]))
        return answers(trees, pairs, column["rep"], column["copies"], least)

    tiles = -(-n // width)
    spread = min(tiles * (tiles + 1) // 2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(spread, "i", "j").groupBy("i", "j").applyInArrow(traverse, "id long, links long, tied long")
