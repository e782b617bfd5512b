"""Rows and texts shared by the tests of this folder."""

import collections
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
FIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text, gap="[\x20\x09-\x0D]+"):
    lower = (text or "").translate({ord(c): c.lower() for c in FIXED})
    return [w for w in re.split(gap, lower) if w]


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def prose(seed, n):
    """n words of a small language, a function of the seed."""
    parts = ["an", "be", "con", "der", "en", "fi", "gra", "ho", "in", "ka", "lo", "mo", "ne", "or", "pla", "ri"]
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        word = ""
        for _ in range(2 + x % 3):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            word += parts[(x >> 33) % len(parts)]
        out.append(word)
    return " ".join(out)


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)
