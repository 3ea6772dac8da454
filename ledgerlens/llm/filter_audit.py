"""What each filter removes in every order of five filters, by Lehmer-rank difference arrays.

A document counts only by the set of filters that it fails.  Orders are numbered as they
sort, which is the number their Lehmer code spells.  All orders that begin alike are
neighbours, so the orders in which a set of failures removes its document at one step are a
few intervals of numbers.  Counts are added where an interval begins and taken off where it
ends; one running sum over the numbers then gives the removals of every order at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlens.llm.batches import slices
from ledgerlens.sources.storage import materialise

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes inside a longer character
_SIGNS = b"#$%&*|"
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20  # bytes of a text whose words are held at once
COUNTED = ("n", "good", "toxic")


def orders(letters: str = FILTERS) -> list[str]:
    """All orders of the filters; an order's place in the list is its Lehmer rank."""
    return ["".join(p) for p in permutations(letters)]


def word_counts(text: bytes, block: int = BLOCK) -> tuple[int, int]:
    """Words and distinct words of a text, block by block."""
    total, seen, start = 0, set(), 0
    while start < len(text):
        blank = _BLANK.search(text, start + block)
        end = blank.start() if blank else len(text)
        words = text[start:end].split()
        total += len(words)
        seen.update(words)
        start = end
    return total, len(seen)


def own_failures(text: bytes) -> int:
    """Filters A to D that a text fails, as bits from A."""
    words, distinct = word_counts(text)
    points = len(text) - _removed(text, _INNER)
    return (words < LEAST_WORDS) \
        | (100 * distinct < LEAST_DISTINCT * words) << 1 \
        | (100 * _removed(text, _CAPITALS) > MOST_CAPITALS * points) << 2 \
        | (_removed(text, _SIGNS) > 0) << 3


def _removed(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def failure_counts(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id",
                   text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``part, failed, n, good, toxic``: rows by the set of filters they fail, as bits from A.

    A text is only moved as its hash.  Rows of equal text are counted in each task first, so
    a text that a third of the table repeats meets as a few rows for every part.  Whether a
    text is found under a smaller id, E, is then known for all rows but those of its
    smallest id.  A document is good (toxic) if one of its labels says so; a null id has no
    label and no smaller id; a null text is empty; a null part is the empty string.
    """
    one = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"),
                      F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"))
    narrow = one.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))) \
        .select("text", "doc_id", "part", "digest")
    kept = [f for f in narrow.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([own_failures(t) for t in texts], pa.int64())],
                names=[*[f.name for f in kept], "failed"])

    rows = materialise(
        narrow.mapInArrow(run, StructType([*kept, StructField("failed", LongType())])), "failures")
    marks = materialise(
        labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .fillna(0, ["good", "toxic"]), "marks")
    none = F.lit(0)
    labelled = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left") \
        .unionByName(rows.where(F.col("doc_id").isNull())
                     .withColumns({"good": none, "toxic": none})) \
        .fillna(0, ["good", "toxic"])

    alike = ["digest", "failed", "part", "good", "toxic"]
    texts = materialise(
        labelled.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*alike).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"),
                             F.min_by("n", "doc_id").alias("n_least"),
                             F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_null")),
        "texts")
    first = materialise(texts.groupBy("digest").agg(F.min("least").alias("first")), "firsts")
    later = F.col("n") - F.coalesce("n_null", none) \
        - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(none)
    e = 1 << FILTERS.index("E")
    split = texts.join(first, "digest").select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("failed"), (F.col("n") - later).alias("n")),
            F.struct((F.col("failed") + e).alias("failed"), later.alias("n")))).alias("s"))
    return split.groupBy("part", F.col("s.failed").alias("failed")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"),
        F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def interval_ends(letters: str = FILTERS) -> Iterator[tuple[int, int, int, int]]:
    """``failed, step, rank, sign``: where intervals of removals begin (1) and end (-1).

    A set of failures removes its document at step k in the orders that begin with k - 1
    filters outside the set and one inside it.  The orders with one such beginning are
    numbered without a gap.
    """
    size = len(letters)

    def begin(left: tuple[int, ...], failed: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        step = size - len(left) + 1
        width = factorial(len(left) - 1)
        for place, letter in enumerate(left):
            low = rank + place * width
            if failed >> letter & 1:
                yield failed, step, low, 1
                yield failed, step, low + width, -1
            else:
                yield from begin(left[:place] + left[place + 1:], failed, low)

    for failed in range(1, 1 << size):
        yield from begin(tuple(range(size)), failed, 0)


def _summed(column: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))


def order_audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step`` and the counts of every step of every order.

    ``counts`` has ``part, failed, n, good, toxic``.  For each part, also one that no filter
    touches, a row for each step of each order: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (its filter's failures that were removed earlier), ``unique_fails`` (that
    fail its filter alone), ``good_lost`` and ``toxic_lost``, and ``shapley``, what its
    filter removes over all orders.  The interval ends are a few hundred rows whatever the
    data, and are broadcast.
    """
    size, names = len(letters), orders(letters)
    spark = counts.sparkSession
    counts = materialise(counts, "counts")
    ends = spark.createDataFrame(
        list(interval_ends(letters)), "failed long, step int, rank int, sign int")
    # Every step of every order has a row, also where nothing begins or ends.
    grid = counts.select("part").distinct() \
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size)))) \
        .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))) \
        .withColumns({c: F.lit(0).cast("long") for c in COUNTED})
    points = counts.join(F.broadcast(ends), "failed") \
        .select("part", "step", "rank", *[(F.col(c) * F.col("sign")).alias(c) for c in COUNTED])
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = points.unionByName(grid).groupBy("part", "step", "rank") \
        .agg(*[F.sum(c).alias(c) for c in COUNTED]) \
        .withColumns({c: F.sum(c).over(along) for c in COUNTED}) \
        .where(F.col("rank") < len(names))

    each = F.array([F.lit(x) for x in letters])
    fails = [F.col("failed").bitwiseAND(F.lit(1 << i)) != 0 for i in range(size)]
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("rows"),
        F.array([_summed("n", f) for f in fails]).alias("fails"),
        F.array([_summed("n", F.col("failed") == 1 << i) for i in range(size)]).alias("alone"))
    named = removed.join(totals, "part") \
        .withColumn("filter_order", F.get(F.array([F.lit(x) for x in names]), F.col("rank"))) \
        .withColumn("letter", F.col("filter_order").substr(F.col("step"), F.lit(1))) \
        .withColumn("filter", F.array_position(each, F.col("letter")).cast("int") - 1)
    before = Window.partitionBy("part", "rank").orderBy("step")
    return named.select(
        "part", "filter_order", "step",
        (F.col("rows") - F.sum("n").over(before)).alias("kept"), F.col("n").alias("removed"),
        (F.get("fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.get("alone", F.col("filter")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of all documents; see ``failure_counts`` and ``order_audit``.

    An empty table gives an empty result; repeated rows are counted each; other columns are
    ignored.
    """
    return order_audit(failure_counts(docs, labels, **columns))
