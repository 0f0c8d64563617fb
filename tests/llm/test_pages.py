"""Page text, WARC archives and quotation links."""

import hashlib
import html
import random
import re
import time
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.llm import html_text, oracles
from loam.llm.html_text import extract, main_text
from loam.llm.quote_links import link_quotes
from loam.llm.warc import archived, read_warc, write_warc
from loam.session import scratch
from tests.conftest import SMALL

LONG = "This paragraph, which is long enough, talks about the matter at hand, and says a lot about it in some words."


def test_articles_of_the_test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r.page_id]
        inner = (page + "</article>").split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<html><body></body></html>", ""), ("just text", "just text"), (f"<p>{LONG}", LONG),
    (f"<div id=main><p>{LONG}</p><p>Short.</p></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG}\nShort."),
    (f"<header>Top</header><main><header><h1>Head</h1></header><p>{LONG}<p>A &amp; B&nbsp;\n C &lt;x&gt;</main><footer>{LONG}</footer>",
     f"Head\n{LONG}\nA & B C <x>"),
    (f"<article><p>{LONG}</p><section id=comments><p>{LONG} no</p></section></article>", LONG),
    (f"<div><p>{LONG}</p><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul><ul><li>a<li>b</ul></div>", f"{LONG}\na\nb"),
    (f"<article><script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}<br>more</p><form><p>no</p></form></article>", f"{LONG} more"),
    (f"<body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use {LONG}</div><article><b>Lead</b> in<p>{LONG}</article>", f"Lead in\n{LONG}"),
    (f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><div role=complementary>no</div></article>", LONG),
    (f"<div><div class=post><p>{LONG}</p></div><div class=post><p>{LONG} Two.</p></div></div>", f"{LONG}\n{LONG} Two."),
])
def test_parts_of_a_page(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-comments", "market-share", "search-results", "widget", "modal", "navy"])
def test_a_wrapper_is_not_lost_for_its_class(name):
    assert main_text(f"<div class='{name}'><article><p>{LONG}</p></article></div>") == LONG
    assert main_text(f"<div class='{name}'><p>{LONG}</p><p>{LONG} Two.</p></div><div class='left-sidebar'><p>{LONG} no</p></div>") == f"{LONG}\n{LONG} Two."


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "comments-section", "ad-slot-1", "share_buttons", "box related-posts"])
def test_known_parts_are_left_out(name):
    assert main_text(f"<div><p>{LONG}</p><p>{LONG} Two.</p><div class='{name}'><p>{LONG} no</p></div></div>") == f"{LONG}\n{LONG} Two."


@pytest.mark.parametrize("page,text", [
    (f"<p>one</p><svg class='i'/><p>{LONG}</p>", f"one\n{LONG}"), (f"<p>one</p><svg/><svg><text>no</text></svg><p>{LONG}</p>", f"one\n{LONG}"),
    (f"<p>one</p><svg><p>{LONG}</p>", f"one\n{LONG}"), (f"<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, {LONG}</p><math/><p>end.</p>", f"As x=2, {LONG}\nend."),
])
def test_drawings_and_formulas(page, text):
    assert main_text(page) == text


def test_broken_and_long_pages(spark):
    rng = random.Random(1)
    tags = ["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "<b", "&amp", "<!--", "-->", "<li>", "</ul>", "<table><tr><td>", "text, more ", "<"]
    pages = ["".join(rng.choice(tags) for _ in range(rng.randrange(60))) for _ in range(300)]
    pages += [None, "", "<p>" * 3000 + "deep", "<div>" * 3000 + LONG, "<p>" + "word, " * 100000, "<" * 5000, "<a " * 3000]
    frame = spark.createDataFrame([(i, None, p, "x", 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in extract(frame).collect()}
    assert len(got) == len(pages) and all(r.text is not None and r.n_chars == len(r.text) for r in got.values())
    assert got[300].text == got[301].text == "" and got[304].text == ("word, " * 100000).strip()
    assert extract(frame.limit(0)).collect() == []


def odd_pages(rng):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: {}\r\n\r\n"
    bodies = [None, "", "short", "x" * 100, "x" * 100, "x" * 99, "x" * 99, "é" * 60, "ends with breaks\r\n\r\n" * 9, "\r\n\r\n", "\r\n", "\n",
              magic.format(5) + "abcde\r\n\r\n", "head\r\n\r\n" + magic.format(5) + "abcde\r\n\r\ntail", magic.format(10 ** 6) + "open", magic,
              "WARC/1.0\r\n" * 50, "before\r\n" + magic.format(20000) + "z" * 30000, "long " * 60000, "WARC/1.0\r"]
    bodies += ["".join(rng.choice(["a", "\r", "\n", "\r\n", "WARC/1.0\r\n", magic.format(3)]) for _ in range(rng.randrange(400))) for _ in range(60)]
    return bodies + ["x" * 100] * 4


@pytest.mark.parametrize("part", ["128m", "64k", "24k"])
def test_archives_round_trip_in_any_split(spark, part):
    rng = random.Random(2)
    bodies = odd_pages(rng)
    ids = rng.sample(range(-50, 1000), len(bodies))
    urls = [rng.choice([None, "http://a/b", "http://a/\r\nX: y"]) for _ in ids]
    frame = spark.createDataFrame(list(zip(ids, urls, bodies, ids)), "page_id long, url string, html string, digest long").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        got = {r.page_id: r for r in archived(frame, scratch(spark, "warc-test")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    raw = {i: (b or "").encode() for i, b in zip(ids, bodies)}
    first = {}
    for i in sorted(raw):
        first.setdefault(raw[i], i)
    assert got.keys() == raw.keys()
    for i, b in raw.items():
        r, again = got[i], len(b) >= 100 and first[b] != i
        assert (r.payload_bytes, r.payload_digest, r.intact) == (len(b), hashlib.sha256(b).hexdigest(), True)
        assert (r.record_type, r.refers_to) == (("revisit", first[b]) if again else ("response", None))


def test_payloads_come_back_whole(spark):
    rng = random.Random(3)
    bodies = odd_pages(rng)
    folder = scratch(spark, "warc-test")
    write_warc(spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string"), folder)
    got = {r.record: bytes(r.payload) for r in read_warc(spark, folder, payloads=True).collect() if r.type == "response"}
    seen = set()
    for i, b in enumerate(bodies):
        b = (b or "").encode()
        if len(b) < 100 or b not in seen:
            assert got[f"<urn:page:{i}>"] == b
        seen.add(b)


def test_repeated_rows_and_no_rows(spark):
    kind = "page_id long, url string, html string"
    rows = [(1, "u", "y" * 200), (1, "u", "y" * 200), (2, "u", "y" * 200), (None, "u", "y" * 200)]
    got = archived(spark.createDataFrame(rows, kind), scratch(spark, "warc-test")).collect()
    assert sorted((repr(r.page_id), r.record_type, r.refers_to) for r in got) == [
        ("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "response", None)]
    assert archived(spark.createDataFrame([], kind), scratch(spark, "warc-test")).collect() == []


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, norm int")


def test_quotes_are_linked_to_what_they_quote(spark):
    rows = [
        (1, 0, "a", "First question, with some words.\nA second line here."),
        (1, 1, "b", "An answer to it."),
        (1, 2, "c", "On Monday a wrote:\n> First question,   with SOME words\n> a second line here\n\nMy reply."),
        (1, 3, "d", "c wrote:\n> My reply.\n>> First question, with some words.\nNested."),
        (1, 4, "e", "> never written by anyone\nHm."),
        (1, 5, "f", "> A second line here.\n> An answer to it.\nTwo lines, two sources."),
        (1, 6, "g", "> Two lines, two sources.\n> Hm."),
        (2, 10, "a", "> My reply.\nOther conversation."), (2, 30, "b", None), (2, 30, "b", None), (2, 31, "b", "> > \n>\n"),
        (None, 1, "z", "> My reply.\nx"), (3, None, "z", "y")]
    got = {(r.conv_id, r.turn, r.role): r for r in link_quotes(chat(spark, rows)).collect()}
    find = lambda turn: next(r for k, r in got.items() if k[:2] == (1, turn))
    assert [find(t).reply_to for t in range(7)] == [None, 0, 0, 2, 3, 0, 5]
    assert [find(t).depth for t in range(7)] == [0, 1, 1, 2, 3, 1, 2]
    assert [find(t).n_quotes for t in range(7)] == [0, 0, 1, 2, 1, 1, 1]
    assert [find(t).n_linked for t in range(7)] == [0, 0, 1, 2, 0, 1, 1]
    assert find(2).text == "My reply." and find(3).text == "Nested." and find(6).text == ""
    assert got[2, 10, "a"].reply_to is None and got[2, 30, "b"].reply_to == 10 and got[2, 30, "b"].text == ""
    assert got[2, 31, "b"].depth == 2 and got[2, 31, "b"].n_quotes == 0
    assert (got[None, 1, "z"].reply_to, got[None, 1, "z"].depth) == (None, 0) and got[3, None, "z"].reply_to is None
    everything = link_quotes(chat(spark, rows))
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    found = duckdb.connect().execute("CREATE TABLE conversations AS SELECT * FROM conversations").execute(oracles.OP8).fetchall()
    assert sorted(map(repr, map(tuple, everything.collect()))) == sorted(map(repr, found))
    assert everything.count() == len(rows)
    assert link_quotes(chat(spark, [])).collect() == []


def test_long_conversations_and_texts(spark):
    rows = [(1, i * 7, "a", f"line {i}") for i in range(3000)] + [(2, 0, "a", "word " * 200000), (2, 1, "b", "> " + "word " * 200000)]
    got = {(r.conv_id, r.turn): r for r in link_quotes(chat(spark, rows)).collect()}
    assert all((got[1, i * 7].reply_to, got[1, i * 7].depth) == (i * 7 - 7 if i else None, i) for i in range(3000))
    assert (got[2, 1].reply_to, got[2, 1].n_linked, got[2, 1].text) == (0, 1, "")


def test_native_operators_stay_native(spark, plan):
    from loam.llm.quality_rules import measured
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for frame in (link_quotes(spark.read.parquet(f"{SMALL}/conversations.parquet")), measured(docs, "text", F.col("doc_id"))):
        assert not re.search("Python|Pandas|Arrow", plan(frame))


def test_the_article_comes_before_main_and_keeps_its_lists():
    words = "one, two, three and more of a text that is read. " * 4
    links = "".join(f"<li><a href='/{i}'>reference number {i}</a></li>" for i in range(3))
    teaser = "<div><p>A teaser of some other text.</p></div>"
    assert html_text.main_text(f"<main><article><p>{words}</p></article>{teaser}</main>") == words.strip()
    inside = html_text.main_text(f"<body><article><p>{words}</p><ul>{links}</ul></article><ul>{links}</ul></body>")
    assert inside.split("\n") == [words.strip()] + [f"reference number {i}" for i in range(3)]
    outside = html_text.main_text(f"<main><p>{words}</p>{teaser}<ul>{links}</ul></main>")
    assert outside.split("\n") == [words.strip(), "A teaser of some other text."]


@pytest.mark.parametrize("part", ["<div><a href=x>link</a>", "<svg a>", "<div>some text that is long enough, for points",
                                  "<svg a></svg><svg b>", "<p><span>text", "<ul><li><a href=x>one</a>"])
def test_time_grows_with_the_page_only(part):
    began = time.process_time()
    html_text.main_text(part * 20_000)
    assert time.process_time() - began < 10


def plain_text(page):
    """The same scoring with a climb to the root for every block."""
    found, _ = html_text.blocks(page, html_text.spared(page))
    text, linked, score = Counter(), Counter(), Counter()
    for node, words, in_links in found:
        for n in node.above():
            text[n] += len(words)
            linked[n] += in_links
        holder = node.up if node.tag in html_text.LEAF and node.up else node
        for depth, n in enumerate(list(holder.above())[:html_text.REACH]):
            score[n] += html_text.points_of(node, words, in_links) / [1, 2, *(3 * d for d in range(2, 99))][depth]
    value = {n: (score[n] + 25 * (n.tag in ("article", "main"))) * (1 - linked[n] / text[n]) for n in text
             if n.tag in html_text.BLOCK and n.tag not in html_text.LEAF}
    if not value:
        return ""
    best = max(value, key=value.get)
    around = [n for tag in ("article", "main") for n in best.above() if n.tag == tag]
    best = around[0] if around else best
    kept = []
    for node, words, in_links in found:
        above = list(node.above())
        beside = best.tag not in ("article", "main") and best.up and (
            any(n.up is best.up and value.get(n, -1) >= value[best] / 5 for n in above)
            or node.up is best.up and node.tag in html_text.LEAF and (
                len(words) > 80 and in_links < len(words) / 4 or not in_links and words[-1] in ".!?"))
        if best in above or beside:
            kept.append(words)
    return "\n".join(kept)


def test_scoring_equals_a_plain_one():
    rng = random.Random(11)
    for _ in range(300):
        page, opened = "", []
        for _ in range(rng.randrange(1, 60)):
            if opened and rng.random() < 0.4:
                page += f"</{opened.pop()}>"
            else:
                opened.append(rng.choice(["div"] * 4 + ["section", "article", "main", "p", "ul", "li", "h2", "blockquote"]))
                page += f"<{opened[-1]}>" + rng.choice(["", "", "word. ", "some words, and more of them. " * rng.randrange(1, 9)])
            if rng.random() < 0.04:
                page += "<a href=x>a link, as it is</a>"
        if page.count("<a ") < 3:  # no list of links
            assert html_text.main_text(page) == plain_text(page), page
