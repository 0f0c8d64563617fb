"""Allow and block rules for urls, fetched by their rarest literal token before any regular expression runs."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANYWHERE = ""
"""Token of rules without a literal token; every url has it."""
UNKNOWN = "\0"
_TOKEN = re.compile(rf"(?<![{UNKNOWN}a-z0-9_])[a-z0-9_]+(?![{UNKNOWN}a-z0-9_])")


class Rule(NamedTuple):
    rule: str
    """`host/path`, or a regular expression over the url without its scheme if `regex`."""
    action: str
    """allow or block"""
    regex: bool = False


# Words that spam hosts and advert paths are named with, and what they may be named together with.
SPAM = ("casino", "casinos", "viagra", "cialis", "porn", "xxx", "payday", "poker", "betting", "jackpot", "replica",
        "cheap-pills", "free-pills", "buy-pills", "spam-farm", "link-farm", "click-farm", "content-farm", "work-from-home", "get-rich")
ADVERTS = ("adserver", "adservice", "doubleclick", "popunder", "clickbank")
PATTERNS = [Rule(rf"^[^/]*\b{w}\b", "block", True) for w in (*SPAM, *ADVERTS)]


def literal_tokens(rule: str, regex: bool) -> list[str]:
    """Lower-case tokens that the text of every match holds whole; none where that can't be told.

    A token is a run of A-Z, a-z, 0-9 and _. In a host and path rule the last one may go on in
    the url, unless the rule ends behind it; the first one may not, as hosts fit by labels.
    In a regular expression only plain characters between plain characters, \\b, ^ and $ count;
    classes, groups and repeated characters may stand for anything, alternatives for none of it.
    """
    if not regex:
        return sorted(set(_TOKEN.findall("/" + rule.translate(str.maketrans(UPPER, LOWER)) + (UNKNOWN if "/" in rule else ""))))
    text, at = [UNKNOWN], 0
    while at < len(rule):
        c = rule[at]
        if c == "\\":
            after = rule[at + 1:at + 2]
            if after in "QE":
                return []
            # \b and \A are of no width; an escaped sign is the sign itself; escaped letters and digits are classes and the like
            text.append(" " if after in "bAzZ" else UNKNOWN if after.isalnum() else after)
            at += 2
            if after in "xucpPk0123456789":  # what follows belongs to it, as far as can be told
                while at < len(rule) and (rule[at].isalnum() or rule[at] in "{}<>"):
                    at += 1
        elif c == "[":
            at = _behind_class(rule, at)
            text.append(UNKNOWN)
        elif c == "(":
            if rule[at + 1:at + 2] == "?" and not re.match(r"\?(?:[:=!>]|<[=!a-zA-Z])", rule[at + 1:]):
                return []  # flags may change the meaning of all that follows
            at = _behind_group(rule, at)
            text.append(UNKNOWN)
        elif c == "|":
            return []
        else:
            at += 1
            if c in "*+?{":
                text[-1] = UNKNOWN
                if c == "{":
                    at = rule.find("}", at) + 1 or len(rule)
            else:
                text.append(" " if c in "^$" else UNKNOWN if c == "." else c)
    return sorted(set(_TOKEN.findall("".join(text).translate(str.maketrans(UPPER, LOWER)) + UNKNOWN)))


def _behind_class(rule: str, at: int) -> int:
    """Position behind the class that begins at `at`; classes may be nested."""
    depth = 0
    while at < len(rule):
        c = rule[at]
        if c == "\\":
            at += 1
        elif c == "[":
            depth += 1
            at += 1
            if rule[at:at + 1] == "^":
                at += 1
            if rule[at:at + 1] == "]":
                at += 1
            continue
        elif c == "]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return at


def _behind_group(rule: str, at: int) -> int:
    depth = 0
    while at < len(rule):
        c = rule[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = _behind_class(rule, at)
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1
    return at


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the rest with its sign: after the first ://, the host up to /, ? or #, A-Z as a-z, the path up to ? or #."""
    behind = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    part = lambda n: F.coalesce(F.regexp_extract(behind, r"(?s)\A([^/?#]*)([^?#]*)(.*)\z", n), F.lit(""))
    return _lower(part(1)), part(2), part(3)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, action string, regex boolean")


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, action, regex, pattern): each rule once, under the token of it that the fewest urls have.

    `urls` has the tokens of different urls. Rules without a literal token are kept under
    a token that all have. Of rules with the same text that differ, block stays.
    """
    @F.pandas_udf("array<string>")
    def tokens(rule: pd.Series, regex: pd.Series) -> pd.Series:
        return pd.Series([literal_tokens(a, b) for a, b in zip(rule, regex)])

    known = rules.where("rule is not null").groupBy("rule", F.coalesce("regex", F.lit(False)).alias("regex")) \
        .agg(F.max("action").alias("action"))
    host, path = F.regexp_extract("rule", r"(?s)\A([^/]*)", 1), F.regexp_extract("rule", r"(?s)\A[^/]*(.*)\z", 1)
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")
    fits = F.concat(F.lit(r"\A(?:[^/]*\.)?"), quoted(_lower(host)), F.when(path == "", F.lit(r"(?:/|\z)")).otherwise(quoted(path)))
    known = known.withColumn("pattern", F.when(F.col("regex"), F.col("rule")).otherwise(fits)) \
        .withColumn("tokens", tokens("rule", "regex"))
    known = stored(known, "rules")
    listed = known.select("rule", "regex", F.explode("tokens").alias("token"))
    counts = urls.select(F.explode("tokens").alias("token")).join(listed.select("token").distinct(), "token") \
        .groupBy("token").agg(F.count("*").alias("n"))
    rarest = listed.join(counts, "token", "left").groupBy("rule", "regex").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return known.join(rarest, ["rule", "regex"], "left").select(
        F.coalesce("least.token", F.lit(ANYWHERE)).alias("token"), "rule", "action", "regex", "pattern")


def judge_urls(table: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row; verdict is allow or block.

    `rules` has rule, action and regex (`Rule`). A host and path rule fits its host and all
    subdomains, if the url's path begins with the rule's; of those that fit the longest wins,
    equally long ones by text. Where none fits, the url is blocked if a regular expression
    with action block is found in it (host, path and the rest, without the scheme) and none
    with action allow; `pattern` names the least one that decided. Any other url is allowed.

    Rules are indexed by one token each, that which the fewest different urls have. The
    tokens of a url fetch candidates by an equal join, and only these are run on it. Both
    sides are left to Spark's size checks, and a token that many urls have is a skewed join.
    Urls that repeat are judged once.

    A null url, or one without ://, has an empty host and path and meets only regular
    expressions that fit an empty text. Null ids stay as they are; rows that repeat are
    each judged; empty input gives no rows, and without rules all urls are allowed.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path, rest = url_parts(F.col("url"))
    signs = F.filter(F.split(_lower(F.concat("host", "path", "rest")), "[^a-z0-9_]+"), lambda t: t != "")
    urls = stored(table.select(url.alias("url")).distinct().select("url", host.alias("host"), path.alias("path"), rest.alias("rest")).withColumn(
        "tokens", F.concat(F.array(F.lit(ANYWHERE)), F.array_distinct(signs))), "urls")
    index = stored(indexed(rules, urls), "rule-index")
    asked = urls.select("url", F.concat("host", "path").alias("place"), F.concat("host", "path", "rest").alias("whole"), F.explode("tokens").alias("token"))
    fitting = asked.join(index, "token").where(
        F.rlike(F.when(F.col("regex"), F.col("whole")).otherwise(F.col("place")), F.col("pattern")))
    plain = ~F.col("regex")
    found = fitting.groupBy("url").agg(
        F.max(F.when(plain, F.struct(F.length("rule").alias("size"), "rule", "action"))).alias("best"),
        F.min(F.when(F.col("regex"), F.struct("action", "rule"))).alias("first"))  # allow comes before block
    judged = urls.select("url", "host", "path").join(found.withColumnRenamed("url", "u"), F.col("url") == F.col("u"), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", "first.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("best").isNull(), F.col("first.rule")).alias("pattern"))
    rows = table.select(F.col(id_col).alias("_id"), url.alias("_url"))
    return rows.join(judged, F.col("_url") == F.col("url")).select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "pattern")
