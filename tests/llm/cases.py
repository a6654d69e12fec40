"""Small tables with every awkward case, and brute-force versions of the operators."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(40_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BASE = "The quick brown fox jumps over the lazy dog while forty other words stand around it. " * 3

ROWS = [
    (5, BASE + PASSAGE, "en", "a", 1),
    (3, PASSAGE + " tail of three, with mail a.b@c.org and 10.0.0.1", "en", "a", 2),
    (9, BASE + PASSAGE, "en", "b", None),
    (9, BASE + PASSAGE, "en", "b", None),
    (11, "  The quick\tbrown fox\n", None, None, 3),
    (12, "The quick brown fox", "en", "c", 4),
    (13, None, "en", "c", 5),
    (14, "", "en", None, 6),
    (15, " \n\t ", "en", "d", 7),
    (16, LONG, "en", "a", 8),
    (17, LONG + " end", "en", "a", 9),
    (None, "no id " + PASSAGE, "en", "a", 10),
    (18, "aaaa" * 200, "en", "e", 11),
    (19, "b" * 333 + "aaaa" * 100, "en", "e", 12),
    (20, "日本語テキスト é ü ñ 𝄞 don't we'll  x''s  's\u00a0\u2003z", "ja", "f", 13),
    (21, "+1 (555) 123-4567 card 4111 1111 1111 1111 and https://x.org/a?b. IBAN: DE89 3704 0044 0532 0130 00", "en", "f", 14),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, size string, score double, kept int, recipe string"


def table(spark, rows=None):
    """The documents, with extra columns named like the operators' own."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, 1, "x", 0.5, 0, "y") for r in rows], SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def ordered(rows):
    """Rows in the order of the operators: by doc_id, null last, then text."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want)), [x for x in zip(sorted(map(repr, got)), sorted(map(repr, want)), strict=False) if x[0] != x[1]][:2]
