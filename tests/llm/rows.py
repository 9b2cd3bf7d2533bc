"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997} it's" for i in range(8_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today"),
    (3, ""),
    (4, None),
    (5, "one"),
    (6, LONG),
    (6, LONG),
    (7, "É à ü ñ 日本語 … Σ"),
    (8, "\n\n \t\n"),
    (None, "a text without an id but with some words of its own"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank tonight"),
]


def documents(spark, rows=None, extra: bool = True):
    """doc_id and text, and columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id long, text string")
    if extra:
        for name in ("digest", "salt", "keep_id", "fp", "rep", "words", "kept", "component_id", "text_digest", "start", "contaminated", "score"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
