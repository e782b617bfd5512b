"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines that the markup says are no article text (menus, page
headers, footers, sidebars, notices, adverts, forms, reader comments, hidden elements) are set aside first and part no
region. On pages that mark their main part (`main`, else `article`) the mark overrides the method: all lines inside are the
text, none outside. On all other pages a line weighs its characters outside links, and weights are summed over sliding
windows of lines: a region begins where the sum surges to `SURGE` characters, with the weighing lines that lead into it,
and ends where it dives to nothing, at a run of links; all lines in between are the text. If no region surges, the one
with the largest window is kept.

Scripts, styles and other raw elements are skipped with their content, comments and declarations as well; an unfinished
tag at the end is markup. Character references are decoded once; runs of white space become one blank; blocks are joined
by a line break, in page order. Null, empty and text-free html give an empty text. Each row is judged by itself, so
repeated rows are alike; extra columns stay as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.llm.common import read_table

NAME = "op6_main_text"
# For the markup of the given pages alone: the blocks of the article.
SQL = r"""
WITH b AS (
  SELECT page_id, url, list_transform(
    string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'),
                       '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
  FROM pages)
SELECT page_id, url, text, length(text) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
"""
WINDOW = 3  # lines of a block
SURGE = 80  # characters outside links in a window that begin a region, on pages without a marked main part

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
NAMED = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW = frozenset("script style noscript template svg math iframe object textarea select button title canvas audio video"
                .split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
                   "pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("br td th".split())  # a blank inside a block
ASIDE = frozenset("nav footer aside form menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disqus footer login menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion recommended related respond search share sharing "
    "sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget complementary "
    "contentinfo".split())
HEADER_WORDS = frozenset("header masthead topbar banner".split())  # outside the main part only
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus".split())


def words_of(attributes: str) -> set[str]:
    found = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes))
    return set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found).lower()))


def is_hidden(attributes: str) -> bool:
    """By an attribute named hidden, aria-hidden=true or a style without display; not by words inside other values."""
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def lines_of(page: str) -> Iterator[tuple[str, bool, str | None, int]]:
    """(text, is it set aside, innermost of main and article around it, characters outside links) of every block with
    text, in page order."""
    parts: list[str] = []
    links: list[str] = []  # the parts inside links
    in_link = False
    aside: list[str] = []  # the element that is set aside, then those of its name inside it
    comments = False
    main: list[str] = []
    at, end = 0, len(page)

    def line() -> tuple[str, bool, str | None, int] | None:
        text = " ".join("".join(parts).split())
        free = len(text.replace(" ", "")) - sum(len("".join(x.split())) for x in links)
        parts.clear()
        links.clear()
        return (text, bool(aside), "main" if "main" in main else main[-1] if main else None, free) if text else None

    while at < end:
        found = MARKUP.search(page, at)
        if not found:
            parts.append(html.unescape(page[at:]))
            if in_link:
                links.append(parts[-1])
            break
        parts.append(html.unescape(page[at:found.start()]))
        if in_link:
            links.append(parts[-1])
        at = found.end()
        if not found["tag"]:
            continue
        tag, closing, rest = found["tag"].lower(), bool(found["end"]), found["rest"]
        if tag in BLOCKS:
            made = line()
            if made:
                yield made
        elif tag in CELLS:
            parts.append(" ")
        if tag == "a":
            in_link = not closing and any(name.lower() == "href" for name, _ in NAMED.findall(rest))
        elif closing and tag in BLOCKS:  # also ends a link that was never closed
            in_link = False
        if closing:
            if aside and tag == aside[-1]:
                aside.pop()
                comments = comments and bool(aside)
            if main and tag == main[-1]:
                main.pop()
            continue
        if tag in RAW and not rest.endswith("/"):
            stop = re.compile(f"</{tag}\\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        if aside and tag in ("main", "article") and not comments:  # an element that was never closed
            aside.clear()
        if aside:
            if tag == aside[-1]:
                aside.append(tag)
        else:
            words = words_of(rest) if rest else set()
            out = tag in ASIDE or words & ASIDE_WORDS or (
                not main and (tag == "header" or words & HEADER_WORDS)) or is_hidden(rest)
            if out and tag not in ("html", "body", "main"):
                if made := line():
                    yield made
                aside.append(tag)
                comments = bool(words & COMMENT_WORDS)
        if tag in ("main", "article") and not aside:
            main.append(tag)
    if made := line():
        yield made


def regions(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """(first, after last) of the runs of lines between a surge and the next dive of the sliding sums."""
    sums = [sum(weights[i:i + WINDOW]) for i in range(len(weights))]
    found, i = [], 0
    while i < len(weights):
        if weights[i] and sums[i] >= surge:
            j = i
            while j < len(weights) and sums[j]:
                j += 1
            found.append((i, j))
            i = j
        else:
            i += 1
    return found


def main_text(page: str | None) -> str:
    lines = [line for line in lines_of(page or "") if not line[1]]  # what is set aside parts no region
    marked = next((m for m in ("main", "article") if any(part == m for _, _, part, _ in lines)), None)
    if marked:
        return "\n".join(text for text, _, part, _ in lines if part == "main" or (marked == "article" and part))
    weights = [free for *_, free in lines]
    if not any(weights):
        weights = [len(text) for text, *_ in lines]
    found = regions(weights, SURGE)
    if not found and any(weights):
        found = [max(regions(weights, 1), key=lambda r: max(sum(weights[i:i + WINDOW]) for i in range(*r)))]
    kept, after = [], 0
    for a, b in found:
        while a > after and weights[a - 1]:  # short lines that lead into the region
            a -= 1
        kept += [text for text, *_ in lines[a:b]]
        after = b
    return "\n".join(kept)


def main_text_column(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return extract(page)


def extracted(pages: DataFrame) -> DataFrame:
    """pages with `text` and `n_chars` (code points)."""
    return pages.withColumn("text", main_text_column(F.coalesce("html", F.lit("")))).withColumn(
        "n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars")
