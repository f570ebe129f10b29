"""Rows that operators must take without falling over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names that operators use inside; an input may have columns of the same name.
CLASHES = ["rid", "row", "kept", "id", "of", "size", "copies", "taken", "key", "pos", "fp", "place", "cut", "n_dropped"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES)
COPIED = "a passage that is long enough to be found again in another text " * 12

TEXTS = [
    (1, "One line to share here\nonly in one\nx"),
    (2, "One line to share here\nelse where\nx"),
    (2, "One line to share here\nelse where\nx"),  # a repeated row
    (2, "the same id\nbut another text"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b "),
    (None, "a row without an id\nOne line to share here"),
    (None, None),
    (6, COPIED),
    (7, "Before it " + COPIED + " behind it"),
    (8, COPIED),
    (9, "ünï ﬁ 😀\n" * 3),
    (10, "word " * 30_000),
    (11, "\n" * 2_000 + "  ONE LINE TO SHARE HERE\t"),
    (12, "nothing in common with the rest of them at all"),
]


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(i, t, "en" if i else None, f"s{i % 3}" if i and i % 5 else None, len(t or ""), *["clash"] * len(CLASHES))
            for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
