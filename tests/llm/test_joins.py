"""Shingle join and embedding join against comparisons of all pairs."""

import collections
import math
import random
import sys
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.llm import embedding_dedup
from loam.llm.embedding_dedup import near_duplicates
from loam.llm.jaccard_join import jaccard_join, jaccard_links, tallied
from loam.llm.shared import components


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def groups(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):  # near copies around the threshold
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += [" ".join(word() for _ in range(rng.randrange(5, 40))) + " " + passage for _ in range(15)]  # one passage, other texts
    texts += [None, "", " \n\t", "one", "one", "one two", "One  two", "a\x1cb", "é É", "x " * 4000, "x " * 4001]
    return texts + texts[:6]


@pytest.mark.parametrize("k,num,seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_shingle_groups_equal_all_pairs(make_docs, k, num, seed):
    rng = random.Random(seed)
    texts = corpus(rng)
    ids = rng.sample(range(10 ** 6), len(texts))
    sets = {i: shingle_set(t, k) for i, t in zip(ids, texts)}
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups(ids, linked)
    got = jaccard_join(make_docs([(i, t, "en", "a") for i, t in zip(ids, texts)]), k=k, num=num).collect()
    assert len(linked) > 10 and len(got) == len(ids)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_a_group_around_one_text(make_docs):
    """Copies that are linked to the middle one only, the chain's ends not being alike."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(100)] = f"x{i}"
        copy[rng.randrange(100)] = f"y{i}"
        rows.append((100 + i, " ".join(copy), None, None))
    rows.append((999, " ".join(base), None, None))
    sets = {r[0]: shingle_set(r[1], 3) for r in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])]
    want = groups(list(sets), linked)
    assert {r.doc_id: r.component_id for r in jaccard_join(make_docs(rows), k=3, num=90).collect()} == want


@pytest.mark.parametrize("k,num,seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_no_link_is_lost(make_docs, monkeypatch, k, num, seed):
    """Every linked pair is given, also within a group; a large group in more than one block."""
    monkeypatch.setattr(sys.modules["loam.llm.jaccard_join"], "BLOCK", 8)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    texts = corpus(rng) + [" ".join(f"x{i}" if j == at else w for j, w in enumerate(base)) for i, at in enumerate(rng.choices(range(100), k=40))]
    ids = rng.sample(range(10 ** 6), len(texts))
    sets = {i: shingle_set(t, k) for i, t in zip(ids, texts)}
    links, linked = dict.fromkeys(ids, 0), []
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                linked.append((a, b))
    want = groups(ids, linked)
    docs = make_docs([(i, t, "en", "a") for i, t in zip(ids, texts)])
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard_join(docs, k=k, num=num).collect()}
    assert len(linked) > 100 and got == {i: (links[i], want[i]) for i in ids}


def test_a_large_group_stores_rows_in_proportion(make_docs):
    """Near copies have as many links as pairs; what is stored grows with the copies."""
    rng = random.Random(8)
    stored = {}
    for size in (100, 400):
        rows = []
        for i in range(size):
            copy = [f"w{j}" for j in range(400)]
            copy[rng.randrange(400)] = f"x{i}"
            rows.append((i, " ".join(copy), None, None))
        found = jaccard_links(make_docs(rows), k=5, num=80)
        stored[size] = found.tallies.count()
        summed = {r["id"]: r["n"] for r in found.tallies.groupBy("id").agg(F.sum("links").alias("n")).collect()}
        assert summed == dict.fromkeys(range(size), size - 1)
    assert stored[400] <= 4 * stored[100] + 10 <= 500


def test_steps_are_stored_in_files_by_size(make_docs, monkeypatch):
    """Steps that keep little of what their tasks read do not leave a file for each task."""
    module = sys.modules["loam.llm.jaccard_join"]
    files, original = collections.defaultdict(list), module.stored

    def counted(frame, purpose):
        out = original(frame, purpose)
        files[purpose].append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "stored", counted)
    rng = random.Random(5)
    docs = make_docs([(i, t, None, None) for i, t in enumerate(corpus(rng))]).repartition(16)
    assert jaccard_links(docs, k=3, num=90).tallies.count() > 0
    assert max(files["rows"] + files["sketch"]) > 4
    assert [files[p] for p in ("star", "sets", "refs", "parts", "close", "pairs", "tallies")] == [[1], [1, 1], [1], [1], [1], [1], [1]]


def test_counts_and_ties_of_blocks():
    """The sums of a pair of blocks against its sets, compared one by one."""
    rng = random.Random(12)
    hub = set(range(60))
    sets = []
    for i in range(50):
        gone = set(rng.sample(sorted(hub), rng.randrange(12)))
        sets.append((hub - gone) | {1000 + rng.randrange(30) for _ in range(rng.randrange(8))})
    frame = pd.DataFrame({"id": rng.sample(range(1000), 50), "n": [len(s) for s in sets], "copies": [1 + i % 3 for i in range(50)],
                          "diff": [np.array(sorted(s ^ hub), dtype=np.int64) for s in sets]})
    for x, y in ((frame, frame), (frame[:20], frame[20:]), (frame[:0], frame)):
        cut = len(x) if x is not y else 0
        linked = [(a, b) for a in range(len(x)) for b in range(len(y))
                  if (x is not y or a != b) and 10 * len(sets[a] & sets[b + cut]) >= 8 * len(sets[a] | sets[b + cut])]
        ids = list(frame["id"])
        want = groups(ids, [(ids[a], ids[b + cut]) for a, b in linked])
        links = collections.Counter()
        for a, b in linked:
            links[ids[a]] += int(y["copies"].iloc[b])
            if x is not y:
                links[ids[b + cut]] += int(x["copies"].iloc[a])
        got = tallied(x, y, 8, 10)
        assert dict(zip(got["id"], got["links"])) == links and {i: want[i] for i in links} == dict(zip(got["id"], got["tied"]))


def test_repeated_and_null_ids(make_docs):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(7, long, None, None), (7, long, None, None), (8, long, None, None), (7, "quite another text than that one", None, None),
            (9, "quite another text than that one", None, None), (None, long, None, None)]
    got = sorted((repr(r.doc_id), r.component_id) for r in jaccard_join(make_docs(rows)).collect())
    assert got == [("7", 7)] * 3 + [("8", 7), ("9", 7), ("None", got[-1][1])]
    assert jaccard_join(make_docs([])).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (3, 2)]
    names = list(range(2000))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    want = groups({n for e in edges if e[0] != e[1] for n in e}, edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def vectors(rng, dim=16):
    draw = np.random.default_rng(rng.randrange(100))
    unit = lambda x: x / np.linalg.norm(x)
    out = []
    for _ in range(60):
        c = unit(draw.normal(size=dim))
        out.append(c)
        for _ in range(rng.randrange(5)):
            out.append(unit(c + draw.normal(size=dim) * rng.choice([0.02, 0.06, 0.08, 0.1])) * rng.choice([1, 3.5]))
    walk = unit(draw.normal(size=dim))
    for _ in range(40):  # a chain whose ends are not alike
        walk = unit(walk + draw.normal(size=dim) * 0.05)
        out.append(walk)
    near = unit(draw.normal(size=dim))
    out += [unit(near + draw.normal(size=dim) * 0.01) for _ in range(80)]
    return [np.array(v, dtype=np.float32).tolist() for v in out]


@pytest.mark.parametrize("size,least", [(1 << 20, 0.95), (16 * 4 * 40, 0.95), (16 * 4 * 40, 0.8)])
def test_vector_links_equal_all_pairs(spark, monkeypatch, size, least):
    rng = random.Random(7)
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15]
    vs = vectors(rng)
    vs += vs[:9] + vs[:3] + [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0]] + odd
    ids = rng.sample(range(10 ** 6), len(vs))
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vs]
    links = {i: 0 for i in ids}
    linked = []
    for a in range(len(vs)):
        for b in range(a):
            if fine[a] and fine[b] and len(vs[a]) == len(vs[b]):
                x, y = np.array(vs[a]), np.array(vs[b])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    linked.append((ids[a], ids[b]))
                    links[ids[a]] += 1
                    links[ids[b]] += 1
    want = groups(ids, linked)
    frame = spark.createDataFrame(list(zip(ids, vs, ids)), "vec_id long, embedding array<float>, label long")
    original = embedding_dedup._block_links
    monkeypatch.setattr(embedding_dedup, "_block_links", lambda own, dim, n, least, rows, most: original(own, dim, n, least, min(rows, size // (4 * dim)), most))
    got = near_duplicates(frame, least=least).collect()
    assert len(linked) > 3000 and len(got) == len(ids)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_vectors_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_cover_trees_are_nested():
    x = np.random.default_rng(3).normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, levels = embedding_dedup.cover(x)
    assert sorted(order) == list(range(300))
    y = x[order]
    for (nodes, radius), finer in zip(zip(levels, embedding_dedup.RADII), [*levels[1:], None]):
        for a, b in nodes:
            assert (np.linalg.norm(y[a:b] - y[a], axis=1) <= radius + 1e-3).all()
        if finer is not None:
            assert set(nodes[:, 0]) <= set(finer[:, 0])


def block(x, axes=16):
    """A tree of some vectors, and the vectors in its order."""
    v = np.ascontiguousarray(x, dtype="<f4")
    dim = v.shape[1]
    order, levels = embedding_dedup.cover(embedding_dedup.units(v.tobytes(), dim))
    first = np.full(len(v), len(levels))
    for k in reversed(range(len(levels))):
        first[levels[k][:, 0]] = k
    return embedding_dedup.Tree(v[order], first, np.linalg.svd(np.random.default_rng(1).normal(size=(axes, dim)), full_matrices=False)[2][:axes])


@pytest.mark.parametrize("at_once", [1 << 18, 1 << 10])
@pytest.mark.parametrize("least", [0.95, 0.6])
def test_links_of_blocks_equal_all_pairs(monkeypatch, at_once, least):
    """Of vectors with any depth of nesting, products in one slice or many."""
    monkeypatch.setattr(embedding_dedup, "AT_ONCE", at_once)
    draw = np.random.default_rng(9)

    def nested(dim, *parts):
        x = np.zeros((1, dim))
        for n, spread in parts:
            x = np.repeat(x, n, axis=0) + draw.normal(size=(len(x) * n, dim)) * spread / dim ** 0.5
        return x

    kinds = [(nested(64, (400, 1)), nested(64, (300, 1))), (nested(3, (500, 1)), nested(3, (300, 1))), (nested(16, (1, 1)), nested(16, (50, 1))),
             (nested(16, (1, 1), (6, 0.5), (8, 0.3), (9, 0.1)),) * 2, (nested(64, (1, 1), (10, 0.8), (60, 0.15)),) * 2, (nested(32, (1, 1), (700, 0.05)),) * 2,
             (nested(24, (1, 1), (4, 0.4), (100, 0.35)),) * 2, (nested(5, (1, 1), (3, 0.9), (200, 0.2)), nested(5, (300, 1)))]
    found = 0
    for x, y in kinds:
        a, b = block(x), block(y)
        cosines = a.units(slice(None)) @ b.units(slice(None)).T
        assert (abs(cosines - least) > 1e-12).all()
        got = [pair for p, q in embedding_dedup.linked(a, b, least) for pair in zip(p.tolist(), q.tolist())]
        assert sorted(got) == list(zip(*(k.tolist() for k in np.nonzero(cosines >= least))))
        found += len(got)
    assert found > 100_000


def test_a_block_of_near_copies_takes_bounded_memory():
    """Its pairs are counted in parts, not held together: they are 9 million and took 16 bytes each, several times."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=64) + draw.normal(size=(3000, 64)) * 0.01
    tree, ids = block(x), draw.permutation(3000)
    tracemalloc.start()
    got = embedding_dedup.answers([tree], iter([(0, 0)]), ids, np.ones(3000, dtype=np.int64), 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    assert sorted(got["id"].to_pylist()) == list(range(3000)) and set(got["links"].to_pylist()) == {2999} and set(got["tied"].to_pylist()) == {0}


def test_short_vectors_make_no_larger_blocks(spark, monkeypatch):
    """A block's tree takes the square of its rows, whatever their length."""
    sizes, original = [], embedding_dedup._block_links
    monkeypatch.setattr(embedding_dedup, "_block_links", lambda own, dim, n, least, size, most: sizes.append(size) or original(own, dim, n, least, size, most))
    got = near_duplicates(spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert len(got) == 9 and 256 <= max(sizes) <= 4096


def test_blocks_meet_as_rows_in_tiles(spark, monkeypatch):
    """A vector is sent as a row of its own, once for each tile that its cell may have links in."""
    sent, original = [], type(spark.range(0)).repartition

    def counted(self, n, *by):
        if by == ("i", "j"):
            sent.append([tuple(r) for r in self.groupBy("i", "j").agg(F.count("*"), F.max(F.octet_length("v"))).collect()])
        return original(self, n, *by)

    monkeypatch.setattr(type(spark.range(0)), "repartition", counted)
    draw = np.random.default_rng(6)
    x = np.repeat(np.eye(16)[:6], 200, axis=0) + draw.normal(size=(1200, 16)) * 0.05
    x[::200] = x[0] + draw.normal(size=(6, 16)) * 0.01  # one of each two hundred is near the first
    x = x.astype("<f4")
    y = embedding_dedup.units(x.tobytes(), 16)
    linked = y @ y.T >= 0.95
    want = groups(range(1200), list(zip(*(k.tolist() for k in np.nonzero(np.triu(linked, 1))))))
    inner = embedding_dedup._block_links
    for tile, most in ((1, 512), (2, 512), (16, 1)):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        monkeypatch.setattr(embedding_dedup, "_block_links", lambda own, dim, n, least, size, _, most=most: inner(own, dim, n, least, 40, most))
        got = near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(linked[i].sum()) - 1, want[i]) for i in range(1200)}
    assert all(longest == 64 and i <= j for found in sent for i, j, _, longest in found)
    tiles = [1 + max(j for _, j, _, _ in found) for found in sent]
    rows = [sum(n for _, _, n, _ in found) for found in sent]
    assert rows[0] < 1200 * tiles[0] / 2 and rows[2] == 1200 * tiles[2]  # most cells lie far apart; one cell meets all its tiles
