"""Quality rules whose thresholds adapt to each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.shared import let, stored, words

WINDOW = 8
GAMMA = 1.02
SIDES = {"word_length": (True, 0.5), "symbol_share": (False, 0.05), "dup_line_share": (False, 0.1),
         "repeat_share": (False, 0.1)}
"""Per measure: whether low values fail too, and the least spread of a group."""


def repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice; window i covers words i to i + 7."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    def starts(s):
        pairs = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    def covered(p):
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    return let(let(marked, starts), covered)


def measured(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    out = docs.select(*[c.alias(n) for c, n in zip(keep, names)], text.alias("t"))
    out = out.select(*names, "t", words(F.col("t")).alias("w"),
                     F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"))
    h = out.select(*names, F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("chars"),
                   F.regexp_count(F.col("t"), F.lit(r"[#*$%&|<>]")).alias("symbols"), F.size("lines").alias("n_lines"),
                   F.size(F.array_distinct("lines")).alias("distinct_lines"),
                   F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words
        h = h.withColumn("h", F.zip_with("h", F.slice("h", step + 1, F.greatest("n", F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    h = h.withColumn("h", F.slice("h", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))))
    repeat = F.when(F.size(F.array_distinct("h")) < F.size("h"), repeated(F.col("h"))).otherwise(0)
    return h.select(*names, *[c.cast("long").alias(n) for n, c in {
        "n_words": F.col("n"), "word_chars": F.col("chars"), "n_symbols": F.col("symbols"), "n_lines": F.col("n_lines"),
        "n_dup_lines": F.col("n_lines") - F.col("distinct_lines"), "n_repeat_words": repeat}.items()])


def measures() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def fences(sketch: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys, measure, rows, low, high) from merged sketches (keys, measure, bucket, n)."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("rows"))
    value = (F.pow(F.lit(GAMMA), F.col("bucket")) - 1) / 100
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), value))
    out = run.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    floor = F.coalesce(*[F.when(F.col("measure") == m, F.lit(s)) for m, (_, s) in SIDES.items()])
    spread = F.greatest(F.col("q3") - F.col("q1"), floor)
    low = F.when(F.col("measure").isin([m for m, (two, _) in SIDES.items() if two]), F.col("q1") - reach * spread)
    return out.select(*keys, "measure", "rows", low.alias("low"), (F.col("q3") + reach * spread).alias("high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", reach: float = 3.0, least_rows: int = 100) -> DataFrame:
    """Measures of every document and whether it is kept.

    Base rules: fewer than 20 words, or over 30% of the words in repeated 8-word windows,
    fail. Beyond them four measures (word length, symbols a word, share of repeated lines,
    share of repeated words) are held against fences of the document's language and
    source: `reach` spreads beyond the quartiles. The quartiles come from log-bucket
    sketches: counts by language, source, measure and bucket of 2% width, so sketches
    merge by adding counts, in any order, with the same result. Only documents that pass
    the base rules enter. Where a language and source have fewer than `least_rows` rows
    the merged sketch of the language is used, and where that has fewer that of all rows.
    Fences are joined back on language and source (a few rows each).

    Null text counts as empty and fails; null language or source form groups of their
    own; repeated rows each get a row; empty input gives none; further columns are
    ignored. Windows are compared by 64-bit hash within one text.
    """
    m = measured(docs, text_col, F.col(id_col), F.col(lang_col), F.col(source_col))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stored(m.select(F.col("k0").alias("id"), F.col("k1").alias("lang"), F.col("k2").alias("source"), "n_words", "word_chars",
                           "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed")), "rules")
    bucket = lambda x: F.ceil(F.log1p(100 * x) / F.log(F.lit(GAMMA)))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(c).alias("bucket")) for n, c in measures().items()]))
    sketch = stored(rows.where("not base_failed").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket")
                    .agg(F.count("*").alias("n")), "rules")
    pairs = rows.select("lang", "source").distinct().withColumnsRenamed({"lang": "l", "source": "s"})
    levels = []
    for depth, keys in enumerate((["lang", "source"], ["lang"], [])):
        same = F.lit(True)
        f = fences(sketch, keys, reach)
        for key, own in zip(keys, ("l", "s")):
            same = same & F.col(own).eqNullSafe(F.col(key))
        f = f.where(F.col("rows") >= least_rows) if depth < 2 else f
        joined = pairs.join(f, same) if keys else pairs.join(F.broadcast(f))  # four rows
        levels.append(joined.select("l", "s", "measure", F.lit(depth).alias("depth"), "low", "high"))
    best = levels[0].union(levels[1]).union(levels[2]).groupBy("l", "s", "measure") \
        .agg(F.min_by(F.struct("low", "high"), "depth").alias("f")) \
        .groupBy("l", "s").agg(F.map_from_entries(F.collect_list(F.struct("measure", "f"))).alias("f"))
    inside = F.lit(True)
    for name, value in measures().items():
        f = F.col("f")[name]
        inside = inside & F.coalesce(value <= f["high"] + 1e-9, F.lit(True)) & F.coalesce(value >= f["low"] - 1e-9, F.lit(True))
    judged = rows.join(best, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & inside).alias("kept"))
