"""Plain-Python versions of what several operators share, and small tables of awkward rows."""

from __future__ import annotations

import re

AWKWARD = [
    (1, "Hello World", "en", "a", 11),
    (2, "hello world", "en", "a", 11),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n", "de", "b", 3),
    (6, "É a ß €𝄞", "fr", "c", 8),
    (6, "É a ß €𝄞", "fr", "c", 8),
    (7, "word " * 3000, "en", "c", 15000),
    (None, "no id", "en", None, 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def awkward(spark):
    """Awkward rows, with a column whose name clashes with ones that operators make inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "h", "n", "bucket", "key", "rep")})
