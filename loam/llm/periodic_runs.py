"""Periodic stretches of words, found through a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.shared import let, words

LEAST, TIMES = 24, 3
TOGETHER = 1 << 18
"""Words of short documents that are looked through at once; a longer document is alone."""


def runs(named: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of numbers, in order of start, then period.

    Negative numbers are borders: they equal nothing. A run is a stretch with the smallest
    period q and at least max(least, times * q) long that can't be extended; times is 3 or more.

    Dictionary of basic factors: the factors of length 1, 2, 4, ... are named by number, a
    factor of twice the length being the pair of its halves' names. Factors that occur once
    are left out, as are all longer ones that begin there. Where a factor of length L occurs
    again within d <= L words, both occurrences have the period d, and d is the smallest such
    distance and so the smallest period. Positions in a row with the same d are an arithmetic
    progression's beginnings, and they reach from the first to the last place where the
    period holds: joined, they are extended as far as it goes. A period q is proposed first
    where L / 2 < q <= L (three times q hold q + L words), and again by longer factors;
    runs proposed twice are one.
    """
    if times < 3:
        raise ValueError("a factor of a power of two that holds the period must come twice in a run: times is 3 or more")
    n, length = len(named), 1
    at = np.flatnonzero(named >= 0)
    name = np.full(n, -1, dtype=np.int64)
    name[at] = named[at]
    found = [np.zeros((0, 3), dtype=np.int64)]
    while len(at):
        # positions by name, then place: what follows in a name is the successor
        by = at[np.argsort(name[at], kind="stable")]
        same = name[by[1:]] == name[by[:-1]]
        gap = by[1:] - by[:-1]
        close = same & (gap <= length)
        i, d = by[:-1][close], gap[close]
        if len(i):
            back = np.argsort(i, kind="stable")
            i, d = i[back], d[back]
            begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])]))
            ends = np.concatenate([begins[1:], [len(i)]]) - 1
            period = d[begins]
            size = i[ends] - i[begins] + length + period
            fits = size >= np.maximum(least, times * period)
            found.append(np.stack([i[begins], size, period], axis=1)[fits])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        kept = np.zeros(n, dtype=bool)
        kept[by[twice]] = True
        at = by[twice]
        at = at[at + length < n]
        at = np.sort(at[kept[at + length]])
        if not len(at):
            break
        pairs = name[at] * (name.max() + 1) + name[at + length]  # names are below n
        name = np.full(n, -1, dtype=np.int64)
        name[at] = np.unique(pairs, return_inverse=True)[1]
        length *= 2
    every = np.concatenate(found)[:, [0, 2, 1]]
    return np.unique(every, axis=0)[:, [0, 2, 1]]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of some texts as numbers from 0, a border behind each text."""
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known)) for text in texts for w in (*text, b" ")]  # no word is a space
    out = np.array(flat, dtype=np.int64)
    if b" " in known:
        out[out == known[b" "]] = -1
    return out


def judged(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its runs and the places of the words that stay.

    A word goes if it lies in a run behind its first period.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    found = runs(numbered(texts), least, times)
    cover = np.zeros(begins[-1] + 1, dtype=np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(cover) == 0
    where = np.searchsorted(found[:, 0], begins)
    for k, size in enumerate(sizes):
        yield found[where[k]:where[k + 1]] - [begins[k], 0, 0], np.flatnonzero(stays[begins[k]:begins[k] + size])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id, runs, collapsed) for every row of documents.

    runs: all (start, length, period) of the text's words, by start, then period: stretches
    with smallest period q and max(least, times * q) words or more that no neighbouring word
    extends. collapsed: the words left when every run keeps its first period only, joined by
    one space; a word that several runs hold goes if any of them drops it.

    Words are separated by space and U+0009 to U+000D. Null and empty texts have no words:
    no runs and an empty collapsed text. Rows that repeat get a row each, null ids too.
    Texts are read whole; a task holds the texts of an Arrow batch, and looks through several
    short ones at once. Other columns are ignored; empty input gives no rows.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts, size, first = [], 0, at
                while at < whole.num_rows and size < TOGETHER:
                    texts.append((whole.column(1)[at].as_py() or b"").split())
                    size += len(texts[-1])
                    at += 1
                spans, ends, left = [], [0], []
                for (found, stays), text in zip(judged(texts, least, times), texts):
                    spans.append(found)
                    ends.append(ends[-1] + len(found))
                    left.append(b" ".join(text if len(stays) == len(text) else [text[k] for k in stays]).decode("utf-8", "replace"))
                flat = np.concatenate(spans)
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(first, at - first),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], fields=list(run))),
                     pa.array(left, pa.string())], ["id", "runs", "collapsed"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    out = source.mapInArrow(scan, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(F.col("id").alias(id_col), "runs", "collapsed")


def repeated(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids a form of it that repeats a stretch to the end.

    With h the CRC-32 of the id in decimal, g = floor(h / 10) and n words: if h % 10 is 0,
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def turned(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(ws.alias("ws"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            x["ws"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["ws"], (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " "))

    again = let(words(text), lambda ws: F.when(F.size(ws) > 0, turned(ws)))
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(again, text)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """`periodic_runs` with the number of runs, the one of the greatest exponent, and digests for lists and texts.

    Exponents are compared as fractions; ties go to the smallest start, then period.
    """
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda held, x: F.when(more(x, held), x).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        *[c for c in found.columns if c not in ("runs", "collapsed")], F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
