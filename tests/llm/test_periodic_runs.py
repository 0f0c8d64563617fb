"""Runs against trying every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loam.llm.periodic_runs import periodic_runs, repeated, run_digests, runs


def plain_runs(w, least=24, times=3):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, times * q):
                t = w[start:start + length]
                if not any(t[r:] == t[:-r] for r in range(1, q)):
                    found.append((start, length, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequence(rng, size):
    n, k = rng.randrange(size), rng.choice([1, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 3:
            a = rng.randrange(n)
            p, end = rng.randrange(1, max(2, (n - a) // 2 + 1)), rng.randrange(a, n + 1)
            for i in range(a, end):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (2, 3), (6, 4)])
def test_runs_equal_all_periods(least, times):
    rng, seen = random.Random(least), 0
    for _ in range(500):
        w = sequence(rng, 130)
        got = [tuple(map(int, r)) for r in runs(np.array(w, dtype=np.int64), least, times)]
        assert got == plain_runs(w, least, times), w
        seen += len(got)
    assert seen > 100


def test_long_sequences_and_borders():
    assert runs(np.arange(200_000) % 50_000).tolist() == [[0, 200_000, 50_000]]
    assert runs(np.zeros(300_000, dtype=np.int64)).tolist() == [[0, 300_000, 1]]
    cut = np.zeros(60, dtype=np.int64)
    cut[20] = -1  # neither side is long enough by itself, the second one is with four words more
    assert runs(cut).tolist() == [[21, 39, 1]]
    with pytest.raises(ValueError):
        runs(cut, 24, 2)


def plain_repeated(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_digests(doc_id, text):
    w = plain_repeated(doc_id, text)
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(left))


def test_query_equals_plain_version(make_docs):
    rng = random.Random(9)
    texts = [" ".join(f"w{x}" for x in sequence(rng, 160)) for _ in range(250)]
    texts += [None, "", " \n\t ", "a", "a " * 24, "a " * 23, "a\x1cb c " * 30, "é  É\tx\n" * 40, "x y " * 3000 + "z", "p q r s t u v w " * 4]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(3, texts[3], "en", "a"), (None, "b c " * 20, None, None), (7, None, None, None)]
    docs = make_docs(rows)
    got = run_digests(periodic_runs(docs.select("doc_id", repeated(docs["doc_id"], docs["text"]).alias("text"))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_digests(i, t) for i, t, _, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 50 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(250))


def test_operator_gives_spans_and_text(make_docs):
    rows = periodic_runs(make_docs([(1, "so " + "la la lu " * 9 + "end", None, None), (2, None, None, None)])).collect()
    assert {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in rows} == {1: ([(1, 27, 3)], "so la la lu end"), 2: ([], "")}


def test_no_rows(make_docs):
    assert run_digests(periodic_runs(make_docs([]))).count() == 0
