"""Url rules against running every rule on every url."""

import random
import re

import pytest

from loam.llm.url_filters import PATTERNS, Rule, judge_urls, literal_tokens, rule_table

SCHEMA = "page_id long, url string, host int, path int, rule int, token int"


def parts(url):
    url = url or ""
    behind = url.split("://", 1)[1] if "://" in url else ""
    host, path, rest = re.fullmatch(r"(?s)([^/?#]*)([^?#]*)(.*)", behind).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, rest


def judged(url, rules):
    host, path, rest = parts(url)
    fitting, first = [], []
    for r in rules:
        if r.regex:
            if re.search(r.rule, host + path + rest):
                first.append((r.action, r.rule))
        else:
            h, p = re.fullmatch(r"(?s)([^/]*)(.*)", r.rule).groups()
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
                fitting.append((len(r.rule), r.rule, r.action))
    if fitting:
        return host, path, max(fitting)[1], max(fitting)[2], None
    return host, path, None, *(min(first) if first else ("allow", None))


def got(spark, urls, rules, parts_=3):
    rows = spark.createDataFrame([(i, u, 1, 2, 3, 4) for i, u in enumerate(urls)], SCHEMA)
    found = judge_urls(rows, rule_table(spark, rules)).collect()
    assert len(found) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.pattern) for r in found}


ODD = [None, "", "no scheme", "://", "http://", "HTTP://Ex.Example.ORG", "http://example.org/es/", "http://notexample.org/es/x", "http://a.example.org/en/1",
       "http://a.example.org/en/12?x", "http://a.example.org/en/2", "http://com/fr/", "http://x.com/de/?q=/fr/", "http://x.com?/de/", "http://x.com#/de/",
       "http://org", "http://.org/", "http://casino.net/", "http://my-casino.net/a", "http://casinos1.net", "http://x.net/casino", "a://b://c.org/d",
       "http://user@x.org:80/y", "http://x.net/A+B/c.d", "http://x.net/aab\n/c", "http://é.net/caf\u00e9/x", "http://x.net/" + "a/" * 50_000 + "end"]
RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"),
         Rule("X.net/A+B", "block"), Rule("net", "allow"), Rule(r"[a-c]+/c", "block", True), Rule(r"\bend\b", "block", True), Rule(r"caf.\b", "block", True),
         Rule(r"my-(casino|poker)", "allow", True), Rule("example.org/es/", "block")]


@pytest.mark.parametrize("rules", [RULES, RULES[:5] + PATTERNS, RULES[7:], []])
def test_odd_urls(spark, rules):
    urls = ODD + ODD[:8]
    assert got(spark, urls, rules) == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_random_rules_equal_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ads", "shop", "a1", "x_y", "Foo", "b", "news", "example", "org", "com"])
    urls = [f"http://{'.'.join(word() for _ in range(rng.randrange(1, 4)))}/" + rng.choice("/-.?#=").join(word() for _ in range(rng.randrange(5))) for _ in range(400)]
    rules = [Rule(".".join(word() for _ in range(rng.randrange(1, 3))) + rng.choice(["", "/", "/" + word(), f"/{word()}/"]), rng.choice(["allow", "block"])) for _ in range(60)]
    pieces = [word, word, word, lambda: r"\b", lambda: r"\.", lambda: "/", lambda: "[a-z]+", lambda: "(?:ads|b)?", lambda: "-", lambda: ".", lambda: "s?", lambda: r"\w*"]
    rules += [Rule("".join(rng.choice(pieces)() for _ in range(rng.randrange(1, 6))), rng.choice(["allow", "block"]), True) for _ in range(60)]
    rules = list({(r.rule, r.regex): r for r in rules}.values())
    want = {i: judged(u, rules) for i, u in enumerate(urls)}
    assert got(spark, urls, rules) == want
    assert {v[3] for v in want.values()} == {"allow", "block"}


@pytest.mark.parametrize("rule,tokens", [
    (r"\bcheap-pills\b", ["cheap", "pills"]), (r"casino", []), (r"/casino/", ["casino"]), (r"/ab+/", []), (r"a|/b/", []), (r"(?i)/b/", []), (r"^b/c", ["b"]),
    (r"/x[/]/y/", ["y"]), (r"/x(y)/z/", ["z"]), (r"\d/a\.b\.", ["a", "b"]), (r"\Qa\E/b/", []), (r"/a{2}/bc/", ["bc"]), (r"\x41/b/", ["b"]), (r"[[a]/b/]/c/", ["c"])])
def test_literal_tokens(rule, tokens):
    assert literal_tokens(rule, True) == tokens


def test_no_rows(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA), rule_table(spark, RULES)).count() == 0
