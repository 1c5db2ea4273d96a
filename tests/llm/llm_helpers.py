"""Rows and brute-force pieces shared by the tests."""

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def frame(spark, rows, parts=3):
    """documents from (doc_id, text[, source])."""
    out = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(out, SCHEMA).repartition(parts)


PROSE = "the quick brown fox jumps over the lazy dog and then it runs far away from all of us today".split()


def odd_rows():
    """Null, empty, blank, very long, tied and repeated rows."""
    long = " ".join(PROSE[i % len(PROSE)] + str(i % 97) for i in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog"),
        (2, "the  quick brown\tfox jumps over the lazy dog "),
        (3, "the  quick brown\tfox jumps over the lazy dog "),
        (3, "the  quick brown\tfox jumps over the lazy dog "),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b"),
        (7, long),
        (8, long),
        (9, "élan Übung ÀB ñ 日本 語"),
        (None, "a document without an identifier"),
        (10, "x"),
        (11, None),
    ]
