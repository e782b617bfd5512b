"""Extraction rules as data: rule sets, looked up for each text by the key of its set.

One set names its fields in order, and per field the options in the order they are tried. Patterns, anchors, groups and
transforms are values of an option, and one column function reads them all, so a plan has the same size for ten rules as
for ten thousand. Texts stay where they are. A text is only searched by the options of its own set whose fixed words it
holds, up to the first that matches; a task compiles a pattern once and not for every text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Decimal, localcontext
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattmill import extraction_rules as R
from wattmill.functions.numbers import PLAIN_NUMBER
from wattmill.functions.steps import staged

FIELD = "struct<value:string,confidence:double,pattern_index:int>"
# Parameter of the anchored rules: a value is looked for in this many characters after its anchor.
ANCHOR_WINDOW = 500
# Flags: any case; m lets ^ and $ match at lines, s lets . cross them.
VALUE_FLAGS, ANCHOR_FLAGS, MULTI_FLAGS = "(?im)", "(?is)", "(?i)"
ANY_PROVIDER = "*"  # key of the rules that suit any provider


def option(pattern: str, confidence: float, index: int, anchor: str | None = None, transform: str | None = None,
           multi: bool = False, groups: dict | None = None, only_group: int | None = None, flags: str = VALUE_FLAGS) -> tuple:
    """One way to find a field. `groups` names the groups of days, rate and total where a multiple match is summed up."""
    summed = groups if multi and groups and {"days", "rate"} <= set(groups) else {}
    return (None if anchor is None else ANCHOR_FLAGS + anchor, (MULTI_FLAGS if multi else flags) + pattern,
            only_group, transform, multi, summed.get("days"), summed.get("rate"), summed.get("total"), float(confidence), index)


def _provider_rule(rule: R.Rule) -> tuple[str, list[tuple]]:
    entries = [e if isinstance(e, tuple) else (None, e) for e in rule.patterns]
    return rule.field, [option(pattern, rule.confidence, i, anchor, rule.transform, rule.multi, rule.groups)
                        for i, (anchor, pattern) in enumerate(entries)]


def rule_sets() -> list[tuple]:
    """The rule set of each provider, and the universal one."""
    universal = [(field, [option(p, confidence, i, transform=how, only_group=1)
                          for i, (p, confidence, how) in enumerate(patterns)])
                 for field, patterns in R.UNIVERSAL_PATTERNS.items()]
    return [(name, [_provider_rule(r) for r in rules]) for name, rules in R.PROVIDER_RULES.items()] + [(ANY_PROVIDER, universal)]


# ---------------------------------------------------------------- reading a text

_PLAIN = re.compile(PLAIN_NUMBER, re.ASCII)
# Letters that match an ASCII letter in any case but do not become it in lower case, with that letter.
_ODD_CASES = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def folded(text: str) -> str:
    """The text in lower case, letter for letter: what a pattern matches in any case stands at the same place."""
    if not text.isascii():
        for odd, plain in _ODD_CASES.items():
            if odd in text:
                text = text.replace(odd, plain)
    return text.lower()


def fixed_words(pattern: str) -> list[str]:
    """Lower-case pieces of ASCII letters that every match of a pattern contains; some may be missing, none is wrong."""
    text = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    text = re.sub(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", "#", text)  # escapes stand for one character
    text = re.sub(r"\[\^?\]?[^\]]*\]", "#", text)
    while "(" in text:  # from the inside: a group that must match once is its content, others give nothing
        plain = re.sub(r"\((?:\?:)?([^()|?][^()|]*)\)(?![?*{])", r"#\1#", text)
        inner = plain if plain != text else re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})*", "#", text)
        if inner == text:
            return []
        text = inner
    if "|" in text:
        return []
    text = re.sub(r".(?:[?*]|\{[^}]*\})[?+]?", "#", text)
    text = text.replace("+", "#")
    return sorted({w.lower() for w in re.findall("[A-Za-z]{2,}", text)}, key=len, reverse=True)


def first_word(pattern: str) -> str:
    """Lower-case ASCII letters that every match of a pattern begins with; empty if it can begin otherwise."""
    start = re.match(r"(?:\(\?[a-z]+\))?([A-Za-z]+)(?![?*{A-Za-z])", pattern)
    return start[1].lower() if start and fixed_words(pattern) else ""


class _Option(NamedTuple):
    """An option ready to be tried."""

    words: list[str]
    first: str
    anchor: re.Pattern | None
    pattern: re.Pattern
    only_group: int | None
    transform: str | None
    multi: bool
    days: int | None
    rate: int | None
    total: int | None
    confidence: float
    index: int


def _ready(given: tuple) -> _Option:
    anchor, pattern, only_group, transform, multi, days, rate, total, confidence, index = given
    words = fixed_words(pattern) + (fixed_words(anchor) if anchor else [])
    first = "" if anchor or multi else first_word(pattern)
    return _Option(words, first, re.compile(anchor) if anchor else None, re.compile(pattern), only_group, transform, multi, days,
                   rate, total, confidence, index)


def _number(text: str) -> float | None:
    found = _PLAIN.search(text)
    return float(found[1]) if found else None


def _half_up(value: float, digits: int) -> str:
    with localcontext() as ctx:
        ctx.rounding = ROUND_HALF_UP
        return format(Decimal(repr(value)), f".{digits}f")


def _double_text(value: float) -> str:
    """A double as Spark's cast prints it: with an exponent below a thousandth and from ten million."""
    if value == 0 or 1e-3 <= abs(value) < 1e7 or not math.isfinite(value):
        return repr(value).replace("inf", "Infinity")
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    rest = "".join(map(str, digits[1:])) or "0"
    return f"{'-' if sign else ''}{digits[0]}.{rest}E{exponent + len(digits) - 1}"


def _transformed(value: str, how: str | None) -> str:
    if how == "strip_commas":
        return value.replace(",", "")
    if how == "strip_spaces":
        return value.replace(" ", "")
    if how == "cents_to_euros":
        cents = _number(value.replace(",", ""))
        return value if cents is None else _double_text(float(_half_up(cents / 100, 4)) if math.isfinite(cents) else cents)
    return value


def _summed(found: list[tuple[str, ...]], o: _Option) -> str | None:
    """'days - average rate - total' over all matches; None without days, or where a number does not parse."""
    days, rates = [_number(x[o.days - 1]) for x in found], [_number(x[o.rate - 1]) for x in found]
    if None in days or None in rates or not sum(days) > 0:
        return None
    totals = [d * r for d, r in zip(days, rates)] if o.total is None else [_number(x[o.total - 1]) for x in found]
    if None in totals or not math.isfinite(sum(days)) or not math.isfinite(sum(totals)):
        return None
    return f"{int(sum(days))} - {_half_up(sum(totals) / sum(days), 4)} - {_half_up(sum(totals), 2)}"


def _search(text: str, lower: str, o: _Option) -> re.Match | None:
    """First match of an option; where a match must begin with a word, only the places of that word are tried."""
    if not o.first:
        return o.pattern.search(text)
    at = lower.find(o.first)
    while at >= 0:
        match = o.pattern.match(text, at)
        if match is not None:
            return match
        at = lower.find(o.first, at + 1)
    return None


def _value(text: str, lower: str, o: _Option) -> str | None:
    """What an option finds in a text; nothing or an empty text when it does not match."""
    if o.anchor is not None:
        at = o.anchor.search(text)
        if at is None:
            return None
        text = text[at.start():at.start() + ANCHOR_WINDOW]
    if o.multi:
        found = [x.groups("") for x in o.pattern.finditer(text)]
        return (_summed(found, o) if found and o.days is not None else None) or "; ".join(map(" ".join, found))
    match = _search(text, lower, o)
    if match is None:
        return None
    if o.only_group is not None:
        return _transformed(match[o.only_group] or "", o.transform)
    parts = [_transformed(x, o.transform) for x in match.groups("")]
    return " - ".join(x for x in parts if x)


def _finder(sets: Iterable[tuple], fields: list[str]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Function of texts and keys that gives a struct of `fields` per text, null where the key has no set."""
    given = dict(sets)
    ready: dict[str, list] = {}  # of the task

    def find(texts: pa.Array, keys: pa.Array) -> pa.Array:
        known = pc.is_in(keys, pa.array(list(given), keys.type))
        found = {f: ([None] * len(texts), [None] * len(texts), [None] * len(texts)) for f in fields}
        for row, (text, key) in enumerate(zip(texts.to_pylist(), keys.to_pylist())):
            if text is None or key not in given:
                continue
            if key not in ready:
                ready[key] = [(f, [_ready(o) for o in options]) for f, options in given[key] if f in found]
            lower = folded(text)
            for field, options in ready[key]:
                for o in options:
                    for word in o.words:
                        if word not in lower:
                            break
                    else:
                        value = _value(text, lower, o)
                        if value:
                            values, levels, indexes = found[field]
                            values[row], levels[row], indexes[row] = value, o.confidence, o.index
                            break
        columns = []
        for f in fields:
            value = pa.array(found[f][0], pa.string())
            columns.append(pa.StructArray.from_arrays(
                [value, pa.array(found[f][1], pa.float64()), pa.array(found[f][2], pa.int32())],
                ["value", "confidence", "pattern_index"], mask=value.is_null()))
        return pa.StructArray.from_arrays(columns, fields, mask=pc.invert(known))

    return find


def with_found(df: DataFrame, text: str, key: Column, fields: Iterable[str], into: str = "x",
               sets: Iterable[tuple] | None = None) -> DataFrame:
    """df with a struct `into` of `fields`, found in column `text` by the rule set that `key` names; null without a set."""
    fields = list(fields)
    kind = "struct<" + ",".join(f"`{f}`:{FIELD}" for f in fields) + ">"
    find = F.arrow_udf(_finder(rule_sets() if sets is None else sets, fields), kind)
    return staged(df, {into: find(F.col(text), key.cast("string"))})
