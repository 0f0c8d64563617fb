"""Quality scores from a factorisation machine over words and the shape of a text."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8192
KNOWN = 200_000
SHAPES = ["bias", "log_words", "word_length", "distinct", "top_word", "repeats", "symbols", "upper", "digits", "stops",
          "line_length", "dup_lines", "short_words", "log_chars"]
DIMS = WORDS + len(SHAPES)
_SYMBOLS, _UPPER, _DIGITS, _STOPS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".!?"
_bucket: dict[bytes, int] = {}


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values): hashed words of one text with unit length, then its shape."""
    raw = text.encode("utf-8", "surrogatepass")
    listed = raw.split()
    n = len(listed)
    counts = Counter(listed)
    if len(_bucket) > KNOWN:
        _bucket.clear()
    for w in set(counts).difference(_bucket):
        _bucket[w] = zlib.crc32(w.lower()) % WORDS
    at = np.fromiter(map(_bucket.__getitem__, counts), dtype=np.int64, count=len(counts))
    times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    value = np.bincount(at, weights=np.log1p(times), minlength=WORDS)
    hit = value.nonzero()[0]
    value = value[hit] / max(float(np.linalg.norm(value)), 1e-9)
    lengths = np.fromiter(map(len, listed), dtype=np.int64, count=n)
    size, many, lines = max(len(raw), 1), max(n, 1), [x for x in raw.split(b"\n") if x.strip()]
    number = lambda kind: len(raw) - len(raw.translate(None, kind))
    shape = np.array([
        1.0, np.log1p(n) / 8, lengths.sum() / many / 10, len(counts) / many, times.max(initial=0) / many,
        sum(map(operator.eq, listed, listed[1:])) / many, min(number(_SYMBOLS) / many, 3), number(_UPPER) / size,
        number(_DIGITS) / size, number(_STOPS) / many, min(many / max(len(lines), 1), 100) / 100,
        1 - len(set(lines)) / max(len(lines), 1), (lengths <= 2).sum() / many,
        np.log1p(len(text) if n_chars is None else max(n_chars, 0)) / 10])
    return np.concatenate([hit, np.arange(WORDS, DIMS)]), np.concatenate([value, shape]).astype(np.float32)


@dataclass
class Machine:
    """w . x + 1/2 sum over f of ((v_f . x)^2 - v_f^2 . x^2): all pairs in linear time."""

    w: np.ndarray
    v: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at] * x[:, None]
        pairs = 0.5 * ((v.sum(axis=0) ** 2) - (v ** 2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.w[at] @ x + pairs, -30, 30))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int, epochs: int = 30, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Logistic loss, Adam over batches in a fixed order; the start is seeded."""
    draw = np.random.default_rng(7)
    w, v = np.zeros(DIMS), draw.normal(0, 0.02, (rank, DIMS))
    if len(y):
        share = np.clip(y.mean(), 0.02, 0.98)
        w[WORDS] = np.log(share / (1 - share))
    m, s = ([np.zeros_like(p) for p in (w, v)] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for begin in range(0, len(y), 256):
            picked = order[begin:begin + 256]
            at, x = (np.concatenate([rows[i][k] for i in picked]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in picked])
            starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(picked)), sizes)
            vx = v[:, at] * x
            summed = np.add.reduceat(vx, starts, axis=1)
            z = np.add.reduceat(w[at] * x, starts) + 0.5 * (summed ** 2 - np.add.reduceat(vx ** 2, starts, axis=1)).sum(axis=0)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[picked]) / len(picked))[row] * x
            grads = (np.bincount(at, g, DIMS) + decay * w,
                     np.stack([np.bincount(at, g * (summed[f][row] - vx[f]), DIMS) for f in range(rank)]) + decay * v)
            step += 1
            for p, grad, mean, square in zip((w, v), grads, m, s):
                mean += 0.1 * (grad - mean)
                square += 0.001 * (grad * grad - square)
                p -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Machine(w.astype(np.float32), np.ascontiguousarray(v.T, dtype=np.float32))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        chars_col: str | None = "n_chars", label_col: str = "quality", most_rows: int = 3000, rank: int = 4) -> Machine:
    """A machine learnt from at most `most_rows` labelled rows, those with the least hash of the id.

    Ids labelled more than once count by the mean of their labels; of rows that share an id
    one counts. The sample's features (at most 8,206 numbers a row, `most_rows` rows) are
    computed in tasks and learnt from in the driver.
    Without labelled rows every score is a half.
    """
    told = labels.where(train & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")) \
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    picked = told.orderBy(F.xxhash64("id"), "id").limit(most_rows)

    def told_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t or "", n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype("<u2").tobytes() for a, _ in made], pa.binary()),
                 pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary())], ["id", "y", "at", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _chars(docs, chars_col))
    sample = texts.join(F.broadcast(picked), "id").select(F.col("id").cast("string"), "y", "text", "n_chars") \
        .mapInArrow(told_features, "id string, y int, at binary, x binary") \
        .groupBy("id", "y").agg(F.min(F.struct("at", "x")).alias("row")).select("y", "row.*").collect()
    sample.sort(key=lambda r: (r["y"], r["at"], r["x"]))
    y = np.array([r["y"] for r in sample], dtype=np.float64)
    return learn([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in sample], y, rank)


def _chars(docs: DataFrame, chars_col: str | None) -> Column:
    known = chars_col and chars_col in docs.columns
    return (F.col(chars_col) if known else F.lit(None)).cast("long").alias("n_chars")


def score(docs: DataFrame, model: Machine, *keep: Column, text: int | None = None, text_col: str = "text",
          chars_col: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """The kept columns as k0, k1, ... with score (0 to 1) and predicted (1 from the threshold on).

    `text` is the place of the text among the kept columns if it is one of them.

    Null text counts as empty and is scored by its shape alone, a null or missing length
    column is replaced by the text's own length; each row stands for itself; whole texts
    are read.
    """
    names = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8,206 x 5 numbers
    source = docs.select(*[c.alias(n) for c, n in zip(keep, names)], _chars(docs, chars_col),
                         *([F.col(text_col).alias("text")] if text is None else []))
    at_text = len(names) + 1 if text is None else text

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, chars = (batch.column(i).to_pylist() for i in (at_text, len(names)))
            found = np.array([m.score(*features(t or "", n)) for t, n in zip(texts, chars)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:len(names)])
    return source.mapInArrow(scored, f"{schema}{', ' * bool(names)}score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), learnt from labels of ids whose crc32 mod 5 is not 0.

    Language, source and id are no inputs. Other columns are ignored, empty input gives no rows.
    """
    remainder = F.crc32(F.col(id_col).cast("string")) % 5
    model = fit(docs, labels, remainder != 0, id_col, text_col)
    return score(docs, model, F.col(id_col), F.coalesce(remainder == 0, F.lit(False)), text_col=text_col) \
        .withColumnsRenamed({"k0": id_col, "k1": "held_out"})
