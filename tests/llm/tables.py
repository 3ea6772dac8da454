"""Small tables with the awkward cases, and word lists made by rule."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, score double, node long, shard int, n_words long, label string, "
          "bucket long, key long, items string, level int")
EXTRA = (1, 0.5, 2, 3, 4, "x", 5, 6, "y", 7)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text, source); further columns have names that operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows], SCHEMA)


def words(seed: int, n: int, vocabulary: int = 5000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward() -> list[tuple]:
    """Null, empty, blank, tiny, repeated, equal and very long texts; null ids and sources."""
    plain = " ".join(words(1, 60))
    return [
        (1, plain, "b"), (2, plain, "b"), (2, plain, "b"), (3, None, "a"), (4, "", "a"),
        (5, " \t\n ", None), (6, "one", "a"), (7, "One", "c"), (8, " ".join(words(2, 30_000)), "c"),
        (None, "no id here", None), (9, "É" * 50, "ä"), (10, "a\r\nb\x0bc\x00d e", "b"),
        (11, plain.upper(), "b"), (11, "another text of the same id", "b"), (12, "x" * 40_000, "c"),
    ]


def collect(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
