"""Conversations in reply order, from the passages that messages quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.shared import stored

QUOTE = r"^((?:[ \t]*>)+)"
CREDIT = r"(?i)(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$"
"""A line that names the author of the quote below it."""
STRETCH = 1024
BREAK, LINE = "\n", "\t"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """Lines as (level, body, norm); level is the number of quote marks before the body."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, QUOTE, 1)
        body = F.substring(x, F.length(marks) + 1, F.length(x))
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), body.alias("body"), normalised(body).alias("norm"))
    return F.transform(F.split(text, r"\r?\n"), line)


def stretches(lines: Column) -> Column:
    """(level, norm, norms) of every stretch of lines of one level, blank lines ending it.

    Lines are joined with a mark where level or blankness changes, then cut there, so the
    cost is linear in the text. `norms` are the single lines, `norm` all of them.
    """
    before = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("body"), F.lit("").alias("norm"))), lines)
    parts = F.zip_with(lines, before, lambda a, b: F.when(
        a["level"].isNull() | (a["norm"] == ""), F.lit("")).when(
        (a["level"] == b["level"]) & (b["norm"] != ""), F.concat(F.lit(LINE), a["norm"])).otherwise(
        F.concat(F.lit(BREAK), a["level"].cast("string"), F.lit(":"), a["norm"])))
    cut = F.filter(F.split(F.array_join(parts, ""), BREAK), lambda s: s != "")
    said = F.transform(cut, lambda s: F.struct(F.substring_index(s, ":", 1).cast("int").alias("level"), F.regexp_replace(s, "^[0-9]+:", "").alias("said")))
    return F.transform(said, lambda s: F.struct(s["level"].alias("level"), F.replace(s["said"], F.lit(LINE), F.lit(" ")).alias("norm"),
                                                F.split(s["said"], LINE).alias("norms")))


def own_words(lines: Column) -> Column:
    """The message without quotes and without the lines that credit them."""
    after = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body"), F.lit("").alias("norm"))))
    kept = F.zip_with(lines, after, lambda a, b: F.when((a["level"] == 0) & ~((b["level"] > 0) & a["body"].rlike(CREDIT)), a["body"]))
    return F.regexp_replace(F.array_join(F.filter(kept, lambda x: x.isNotNull()), BREAK), r"^\s+|\s+$", "")


def previous(turns: DataFrame) -> DataFrame:
    """(conv, turn, before) of distinct turns, a long conversation being cut into stretches."""
    part = turns.withColumn("part", F.floor(F.col("turn") / STRETCH))
    ends = part.groupBy("conv", "part").agg(F.max("turn").alias("last"))
    ends = ends.select("conv", "part", F.lag("last").over(Window.partitionBy("conv").orderBy("part")).alias("entry"))
    inside = F.lag("turn").over(Window.partitionBy("conv", "part").orderBy("turn"))
    return part.join(ends, ["conv", "part"]).select("conv", "turn", F.coalesce(inside, "entry").alias("before"))


def depths(replies: DataFrame) -> DataFrame:
    """(conv, turn, depth): replies between a turn and the one that answers none.

    Pointers are doubled, so the rounds are the logarithm of the longest chain; turns
    whose chain has ended take no part in further rounds.
    """
    at = stored(replies.select("conv", "turn", F.col("reply_to").alias("up"), F.col("reply_to").isNotNull().cast("long").alias("depth")), "depth")
    while at.where("up is not null").limit(1).count():
        far = at.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        open_ = at.where("up is not null").join(far, ["conv", "up"]).select(
            "conv", "turn", F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        at = stored(open_.union(at.where("up is null").select("conv", "turn", "up", "depth")), "depth")
    return at.select("conv", "turn", "depth")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """Messages without quotes: (conv, turn, role, reply_to, depth, n_quotes, n_linked, text).

    Lines that start with `>` marks are quotes; the marks give the level. A quoted
    passage is a stretch of lines of one level; it and its lines, lower-cased and reduced
    to letters and digits, are hashed (MD5) and joined to the paragraphs, lines and whole
    texts that messages of the conversation wrote themselves. The first message that wrote
    a passage is its source, if it is earlier than the quoting one. A message answers the
    source of its least nested linked quotes, by the number of quoted characters, then the
    later one; without linked quotes it answers the turn before it. Sorted by depth, then
    turn, every message follows the one it answers. n_quotes counts quoted passages,
    n_linked those that were found as a whole or by a line.

    Null texts are empty. A null conversation or turn: no reply, depth 0. Rows that repeat
    a turn get a row each and share its links. Empty input gives no rows; other columns
    are ignored. Sources are reduced to one row for each passage before the join, so a
    passage that many messages share makes no pairs.
    """
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    lines = base.withColumn("lines", parsed(F.col("raw"))).withColumn("parts", stretches(F.col("lines")))
    # rows are told apart by their whole content only where links are counted
    units = lines.where("conv is not null and turn is not null").select("conv", "turn", "raw", "lines", "parts")
    mine = lambda level: F.filter(level, lambda x: (x["level"] == 0) & (x["norm"] != ""))
    norm = lambda x: x["norm"]
    wrote = F.concat(F.transform(mine(F.col("parts")), norm), F.transform(mine(F.col("lines")), norm),
                     F.array(F.array_join(F.transform(mine(F.col("lines")), norm), " ")))
    source = units.select("conv", "turn", F.explode(F.array_distinct(wrote)).alias("norm")).where("norm <> ''") \
        .groupBy("conv", F.md5("norm").alias("hash")).agg(F.min("turn").alias("source"))
    quoting = units.where(F.exists("parts", lambda x: x["level"] > 0)).select(
        "conv", "turn", F.posexplode(F.filter("parts", lambda x: x["level"] > 0)).alias("nth", "part"), F.md5("raw").alias("row"))
    quoted = quoting.select("conv", "turn", "row", "nth", F.col("part.level").alias("level"), F.explode(F.array_distinct(
        F.concat(F.array("part.norm"), F.col("part.norms")))).alias("norm"))
    found = quoted.distinct().withColumn("hash", F.md5("norm")).join(source, ["conv", "hash"]).where("source < turn")
    linked = found.groupBy("conv", "turn", "row").agg(F.countDistinct("nth").alias("n_linked"))
    best = found.groupBy("conv", "turn", "level", "source").agg(F.sum(F.length("norm")).alias("chars")).groupBy("conv", "turn").agg(
        F.max_by("source", F.struct((-F.col("level")).alias("near"), "chars", "source")).alias("answers"))
    turns = units.select("conv", "turn").distinct()
    replies = stored(previous(turns).join(best, ["conv", "turn"], "left").select(
        "conv", "turn", F.coalesce("answers", "before").alias("reply_to")), "replies")
    deep = depths(replies)
    rows = lines.select("conv", "turn", "role", F.md5("raw").alias("row"), F.size(F.filter("parts", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"),
                        own_words(F.col("lines")).alias("text"))
    out = rows.join(linked, ["conv", "turn", "row"], "left").join(replies, ["conv", "turn"], "left").join(deep, ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to",
                      F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text")
