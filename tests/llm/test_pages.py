"""URL rules against SQL and brute force, main text of hand-made and given pages, chat, shards."""

import collections
import hashlib
import html
import random
import re
import zlib

import oracle_check
import public_tokenizers
import pytest
from corpus_rows import as_docs, multiset, prose

from wattmill.llm import byte_shards, chat, main_text, url_rules
from wattmill.llm.common import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def best_rule(url, rules):
    host, path = split_url(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return (host, path, rule and rule[2], rule[3] if rule else "allow")


def test_sweep_equals_trying_every_rule(spark):
    random.seed(8)
    labels = ["a", "b", "com", "net", "x-y", "é"]
    rules = {(".".join(random.choices(labels, k=random.randint(1, 3))), random.choice(["/", "/a", "/a/", "/a/b", ""]))
             for _ in range(40)}
    rules = [(h, p, random.choice(["allow", "block"])) for h, p in sorted(rules)]
    hosts = [".".join(random.choices(labels + ["A", ""], k=random.randint(1, 5))) for _ in range(150)]
    urls = [f"http://{h}{random.choice(['', '/', '/a', '/a/b?x', '/a/#y', '/ab', '?q=http://a.com/'])}" for h in hosts]
    urls += [None, "", "no url", "://", "x://", "http://?a", "HTTP://A.COM/a://b/"] + ["http://a.com/a"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr(
        "*", "'k' as key", "1 as open", "2 as kind", "3 as host", "4 as path")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block")],
                                  "rule_host string, rule_path string, verdict string")
    got = url_rules.judged(pages, table).collect()
    assert multiset(got) == multiset((i, *best_rule(u, rules)) for i, u in enumerate(urls))
    none = url_rules.judged(pages, table.limit(0)).collect()
    assert len(none) == len(urls) and {(r.rule, r.verdict) for r in none} == {(None, "allow")}
    assert url_rules.judged(pages.limit(0), table).count() == 0


def test_equal_rules_with_two_verdicts_block(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("b", "/", "allow"), ("b", "/", "block"), ("b", None, "allow")],
                                  "rule_host string, rule_path string, verdict string")
    assert url_rules.judged(pages, rules).collect()[0].verdict == "block"


@pytest.mark.parametrize("module", [url_rules, main_text, byte_shards])
def test_query_equals_its_sql(spark, sample, module):
    assert oracle_check.compare(spark, oracle_check.connect(sample), module.NAME, sample).startswith("ok")


LONG = "A paragraph of the article with enough words to count as running text, and then some more of them."
CASES = [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<p>a &amp;lt; b &nbsp; c&hellip;</p>", "a &lt; b c…"),
    (f"<nav>Menu</nav><article><h1>T</h1><p>{LONG}<br>x<p>ok</article><footer>f</footer>", f"T\n{LONG} x\nok"),
    (f"<div class='ad top'>Buy</div><main><p>s<p>{LONG}<aside>no</aside><p>e</main>out", f"s\n{LONG}\ne"),
    (f"<body><div id=sidebar><div>in</div>ner</div><p>{LONG}</p><div class=comments><p>{LONG}</p></div>", LONG),
    ("<article><script>var t='</p><p>x</article>';</script><style>p{}</style><!-- <p>c</p> --><p>a</p></article>", "a"),
    ("<article><div>1</div><form><p>2</p></form><div class=cookie-notice>3</div>4 <b>5</b>6</article>", "1\n4 56"),
    ("<ARTICLE><P>a<UL><LI>b<LI>c</UL><P CLASS=\"Advert\">d</P>e</ARTICLE>", "a\nb\nc\ne"),
    ("<article>a<p>b</article><p>c</p><article class='comment'><p>d</article>", "a\nb"),
    ("<nav><p>never closed<article><p>a</article>", "a"), ("<article>a &lt; b <3 c<p>d</article><foo", "a < b <3 c\nd"),
    (f"<p>{LONG}</p><p>x</p><nav>n</nav><ul><li>k</li></ul>", f"{LONG}\nx\nk"),
    ("<article><header><h1>Head</h1></header><p>b</p></article><header>Site</header>", "Head\nb"),
    ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
]


def test_main_text_of_small_pages(spark):
    for page, text in CASES:
        assert main_text.main_text(page) == text, page
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as x")
    got = main_text.extracted(pages).collect()
    assert multiset((r.page_id, r.text, r.n_chars, r.x) for r in got) == multiset(
        (i, CASES[i][1], len(CASES[i][1]), 2) for i, _, _ in rows)
    assert main_text.extracted(pages.limit(0)).count() == 0


def test_main_text_is_the_article_of_given_pages(spark, sample):
    pages = {r.page_id: r.html for r in read_table(spark, sample, "pages").collect()}
    got = main_text.query(spark, sample).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split())
                  for b in re.split("</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b)


TALK = [(1, 0, "user", "hi"), (1, 1, "assistant", "\n\n hello <b>"), (1, 2, "assistant", "</turn>\\l \\\\ <turn>user<text>"),
        (1, 2, "assistant", "twice"), (1, 2, "assistant", "twice"), (2, 1, "assistant", None), (2, 0, None, "😀 é"),
        (3, None, "assistant", "  "), (None, 0, "assistant", "no id"), (4, 0, "user\n<x>", "<|endoftext|>"),
        (5, 0, "assistant", ""), (5, 1, "user", "")]


@pytest.mark.parametrize("part", [1 << 22, 10])
def test_masked_text_is_what_the_assistant_said(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_CHARS", part)
    table = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids")
    if part == 10:
        assert chat.render([("a", "b")])[0] == "<turn>a<text>b</turn>"
    got = chat.digests(chat.formatted(table, PATH), PATH).collect()
    talks = collections.defaultdict(list)
    for conv, turn, role, text in TALK:
        talks[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(talks)
    for r in got:
        turns = sorted(talks[r.conv_id])
        said = "".join(t for _, role, t in turns if role == "assistant")
        every = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(chat.formatted(table.limit(0), PATH), PATH).count() == 0


def test_markers_in_texts_are_undone():
    for text in ("\\### Assistant: </turn> ok", "\\l", "\\\\l<", "<turn>", "a\\"):
        assert "<" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize("rows", [
    [(i, prose(i, 5 + i % 40)) for i in range(300)] + [(5, None), (5, None), (6, ""), (None, "x")] + [(7, "é" * 50)] * 5, []])
def test_shards_are_contiguous_and_even(spark, rows):
    docs = as_docs(spark, rows).selectExpr("*", "1 as size", "2 as shard", "3 as bucket")
    got = byte_shards.byte_shards(docs).collect()
    assert multiset((r.doc_id, r["size"], r.text_crc32) for r in got) == multiset(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    got.sort(key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    target = sum(r["size"] for r in got) / 8
    for part in by_shard.values():
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - target) <= max(r["size"] for r in got)


@pytest.mark.parametrize("page, want", [
    ("<article class='overflow-hidden'><p>a</article>", "a"), ("<article aria-hidden='false'><p>a</article>", "a"),
    ("<article><p>a</p><p hidden>b</p><p HIDDEN=''>c</p><p aria-hidden=true>d</p><p style='x:y;display: none'>e</p>"
     "<p data-x='hidden'>f</p></article>", "a\nf"),
    (f"<p>{LONG}</p><nav>1</nav><nav>2</nav><nav>3</nav><p>The end.</p>", f"{LONG}\nThe end."),
    (f"<p>T</p><p>by me</p><p>2020</p><p>Town</p><p>{LONG}</p>", f"T\nby me\n2020\nTown\n{LONG}"),
    (f"<p>{LONG} <a href=x>more</a></p><ul>" + f"<li><a href='y'>{LONG}</a></li>" * 4 + "</ul>", f"{LONG} more"),
    (f"<ul>{'<li><a href=y>Another page</a></li>' * 9}</ul><p><a name=z>{LONG}</p>", LONG),
])
def test_regions_hold_short_lines_and_no_link_lists(page, want):
    assert main_text.main_text(page) == want
