"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMS = 4096
_PLAIN = np.array([chr(i).isalpha() for i in range(0x10000)])


def grams(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams of one to three letters and the number of letters.

    Other characters count as one blank between words.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    letter = _PLAIN[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    n = int(letter.sum())
    if not n:
        return np.zeros(DIMS, dtype=np.float32), 0
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[np.r_[True, letter[1:] | letter[:-1]]]
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
    hashed = np.concatenate([one, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)]) >> np.uint32(20)
    return np.bincount(hashed, minlength=DIMS).astype(np.float32), n


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    matrix: np.ndarray  # dims x centroids
    owner: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine by language and size of text

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(counts) @ self.matrix
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def clustered(vectors: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """Up to k unit centroids by spherical k-means, started far from each other."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[(vectors @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(turns):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (vectors @ c.T).argmax(axis=1)
        c = np.array([vectors[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def size_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 15)


def few_hashes(ids: DataFrame, group: str, n: int) -> DataFrame:
    """The different ids with the least hashes of each group, at least `n` of them and about 2n.

    An id is taken if its hash lies in the lowest 2n-th of m, of m ids in the group; of that
    many even hashes fewer than n are met with a chance under 1e-13 for 100 and more. Small
    groups (up to 4n) and small `n` are kept whole.
    """
    sizes = ids.groupBy(group).agg(F.count(F.lit(1)).alias("_m")).withColumnRenamed(group, "_group")
    share = F.when((F.col("_m") > 4 * n) & F.lit(n >= 100), 2.0 * n / F.col("_m")).otherwise(1.0)
    at = F.xxhash64("id").cast("double") / 2.0 ** 64 + 0.5
    return ids.join(sizes, F.col(group) == F.col("_group")).where(at <= share).select(*ids.columns)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 600, clusters: int = 4, reach: float = 0.6) -> Centroids:
    """Centroids from at most `per_language` ids of each language: those with the least hash.

    Languages are counted first, so only ids under about twice the hash that is needed are
    ranked. Of rows that share an id and a language one counts. So `per_language` rows of
    n-gram counts (at most 4,096 each) reach the driver for a language, whatever repeats. The least cosine that
    a text of a language and size class (powers of two of letters) is accepted at is
    `reach` times the lowest one among training texts of that and the next classes; where
    there are fewer than five, none is rejected.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).distinct()
    picked = few_hashes(ids, "lang", per_language) \
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t) for t in batch.column(2).to_pylist()]
            keep = [c.nonzero()[0].astype("<u2") for c, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int64()), pa.array([k.tobytes() for k in keep], pa.binary()),
                 pa.array([c[k].astype("<f4").tobytes() for (c, _), k in zip(found, keep)], pa.binary())], ["id", "lang", "n", "at", "count"])

    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), ["id", "lang"]).select(F.col("id").cast("string"), "lang", "text") \
        .mapInArrow(counted, "id string, lang string, n long, at binary, count binary").where("n > 0") \
        .groupBy("id", "lang").agg(F.min(F.struct("n", "at", "count")).alias("row")).select("lang", "row.*").collect()
    sample.sort(key=lambda r: (r["lang"], r["at"], r["count"]))
    languages = sorted({r["lang"] for r in sample})
    counts = np.zeros((len(sample), DIMS), dtype=np.float32)
    for i, r in enumerate(sample):
        counts[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["count"], "<f4")
    label = np.array([languages.index(r["lang"]) for r in sample], dtype=int)
    letters = np.array([r["n"] for r in sample], dtype=int)
    idf = (np.log((1 + len(sample)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Centroids(languages, idf, np.zeros((DIMS, 1), dtype=np.float32), np.zeros(1, dtype=int), np.zeros((len(languages), 16)))
    vectors = model.vectors(counts)
    centres = [clustered(vectors[label == j], clusters) for j in range(len(languages))]
    if centres:
        model.matrix = np.ascontiguousarray(np.concatenate(centres).T, dtype=np.float32)
        model.owner = np.repeat(np.arange(len(centres)), [len(c) for c in centres])
        own, cosine = model.nearest(counts)
        for j in range(len(languages)):
            for s in range(16):
                like = (label == j) & (own == j) & (np.abs(size_class(letters) - s) <= 1)
                model.floor[j, s] = reach * cosine[like].min() if like.sum() >= 5 else 0.0
    return model


def identify(docs: DataFrame, model: Centroids, *keep: Column, text: int | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns as k0, k1, ... with lang_pred, score (cosine, 0 to 1) and rejected.

    `text` is the place of the text among the kept columns if it is one of them.

    Texts that are null or without letters, and all texts where the model knows no
    language, are `und` with score 0 and rejected. A text whose cosine to the nearest
    centroid lies under the floor of that language and size is rejected too; lang_pred
    still names the nearest language. Of equal cosines the first centroid in the order
    of languages counts. Whole texts are read; each row stands for itself.
    """
    names = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4,096 x 4 numbers a language
    source = docs.select(*[c.alias(n) for c, n in zip(keep, names)], *([F.col(text_col).alias("text")] if text is None else []))
    at_text = len(names) if text is None else text

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [grams(t or "") for t in batch.column(at_text).to_pylist()]
                letters = np.array([n for _, n in found])
                own, cosine = m.nearest(np.array([c for c, _ in found]))
                known = (letters > 0) & bool(m.languages)
                floor = m.floor[own, size_class(letters)] if m.languages else np.zeros(len(own))
                lang = [m.languages[j] if k else "und" for j, k in zip(own.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(names)], pa.array(lang, pa.string()), pa.array(np.where(known, cosine, 0.0), pa.float64()),
                     pa.array(~known | (cosine < floor), pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:len(names)])
    return source.mapInArrow(predict, f"{schema}{', ' * bool(names)}lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), learnt from rows whose crc32(id) mod 4 is not 2.

    Columns other than id, text and language are ignored; a null id is never held out.
    Empty input gives no rows.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held_out, id_col, text_col, lang_col)
    return identify(docs, model, F.col(id_col), held_out, text_col=text_col) \
        .withColumnsRenamed({"k0": id_col, "k1": "held_out"})
