"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.shared import stored

LEVELS = 3
BITS = 12


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Every source gets its weight's share of all sizes; a target above `cap` times its
    source's size stops there and the excess is shared by weight among the others, until
    none is above. That end state is min(cap * size, level * weight) for one level, found
    from running sums over the sources in the order in which they fill up. Windows here
    hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    fills = F.col("source_size") * cap / F.col("weight")
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = per.withColumn("fills", fills).select(
        "*", F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("source_size").over(seen), F.lit(0)).alias("filled"), F.sum("weight").over(rest).alias("open"),
        F.row_number().over(order).alias("at"))
    level = ranked.withColumn("level", (F.col("total") - cap * F.col("filled")) / F.col("open"))
    first = F.min(F.when(F.col("fills") >= F.col("level"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return level.withColumn("least", first).select(
        "source", "source_size",
        F.least((F.col("source_size") * cap).cast("double"), F.col("least") * F.col("weight")).alias("target"))


def draw(id_col: str) -> Column:
    """A number below 2^36 for each id."""
    md5 = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(md5, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def mix_plan(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target, whole, threshold) from stored (source, size, h) rows.

    Documents of a source are taken `whole` times, and once more if their h is below the
    threshold. It comes from histograms of size by source and hash bucket: the bucket
    where the running sum passes the rest of the budget is cut again into 4,096, three
    levels deep, and the last one is taken if that ends nearer the target. No rows are
    sorted; only the boundary bucket is looked at again. Histograms hold at most 4,096
    rows a source.
    """
    plan = targets(sized, weights, cap).select(
        "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"))
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan.withColumn("threshold", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long")), "mix")
    for depth in range(1, LEVELS + 1):
        width = 1 << BITS * (LEVELS - depth)
        inside = F.floor(F.col("h") / (width << BITS)) * (width << BITS) == F.col("threshold")
        sums = sized.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).where(inside) \
            .groupBy("source", "budget", "base", (F.floor(F.col("h") / width) * width).alias("start")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("end", F.col("base") + F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
        over = F.col("end") > F.col("budget")
        if depth == LEVELS:
            over = over & ((F.col("end") - F.col("budget")) >= (F.col("budget") - F.col("begin")))
        cut = run.where(over).groupBy("source").agg(F.min(F.struct("start", "begin")).alias("cut")) \
            .select(F.col("source").alias("s"), "cut")
        # where no bucket passes the budget, all that was looked at is below the threshold
        plan = stored(plan.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select(
            "source", "source_size", "target", "whole", "budget",
            F.coalesce(F.col("cut.start"), F.col("threshold") + (width << BITS)).alias("threshold"),
            F.coalesce(F.col("cut.begin"), F.col("base")).alias("base")), "mix")
    return plan.select("source", "source_size", "target", "whole", "threshold")


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long").alias("size"), draw(id_col).alias("h")), "mix")


def copies() -> Column:
    return F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """How often the mix takes each document: (id, source, size, source_size, target, copies, taken).

    Size is the number of words (null text: 0). Every document is taken whole
    floor(target / source_size) times, and once more if its hash lies below its source's
    threshold (`mix_plan`). The hash is of the id, so runs agree; rows with equal ids are
    taken or left together. A null source is a source of its own. Sources without a word
    have target 0. Empty input: no rows. Other columns are ignored, whatever their names.
    """
    sized = sized_rows(docs, id_col, text_col, source_col)
    plan = mix_plan(sized, weights, cap)
    picked = sized.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    return picked.select(F.col("id").alias(id_col), F.col("s").alias("source"), "size", "source_size", "target",
                         copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows that the mix takes, repeated as often as it takes them, with the columns of docs.

    Only the plan, one row a source, is joined to the documents. Cases as for `mix`.
    """
    plan = mix_plan(sized_rows(docs, id_col, text_col, source_col), weights, cap)
    names = [f"k{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("h", draw(names[docs.columns.index(id_col)]))
    own = F.col(names[docs.columns.index(source_col)])
    taken = rows.join(plan, own.eqNullSafe(F.col("source"))).where(copies() > 0)
    return taken.select(*[F.col(n) for n in names], F.explode(F.sequence(F.lit(1).cast("long"), copies())).alias("copy")) \
        .select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5('mix:' || doc_id), 1, 9))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 3 / weight AS fills, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         row_number() OVER o AS nr
  FROM per WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST)),
level AS (
  SELECT arg_min((total - 3 * filled)::DOUBLE / open::DOUBLE, nr) AS level FROM ranked
  WHERE fills >= (total - 3 * filled)::DOUBLE / open::DOUBLE),
target AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM ranked, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM target),
budget AS (SELECT *, target - whole * source_size AS budget FROM plan),
hashed AS (SELECT source, h, sum(size)::BIGINT AS n FROM sized GROUP BY ALL),
run AS (
  SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS stop FROM hashed),
cut AS (
  SELECT r.source, min(h) AS threshold FROM run r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
  WHERE stop > budget AND stop - budget >= budget - (stop - n) GROUP BY r.source)
SELECT s.doc_id, s.source, s.size, b.source_size, b.target,
       whole + (h < coalesce(threshold, 68719476736))::BIGINT AS copies,
       s.size * (whole + (h < coalesce(threshold, 68719476736))::BIGINT) AS taken
FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""
