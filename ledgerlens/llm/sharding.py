"""Shards by a keyed permutation of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.rows import (
    COPIES, KEY, distinct_rows, keyed, repeated, running_total, take_copies, text_bytes, unpacked)
from ledgerlens.sources.storage import materialise

SEED = 20_240_601
ROUNDS = 6
ROWS_PER_BUCKET = 2_000


def permuted(number: Column, rows: int, seed: int = SEED) -> Column:
    """Place of a row number under a permutation of ``0 .. rows - 1``.

    A Feistel network over two digits of base ``a`` and ``b`` with ``a * b >= rows``.
    Each round adds a keyed hash of one digit to the other, so it can be undone.  A
    place outside the table is permuted again until it lies inside (cycle walking);
    fewer than ``a`` places lie outside, which bounds the walk.
    """
    if rows < 2:
        return number
    a = math.isqrt(rows - 1) + 1
    b = -(-rows // a)
    keys = F.array(*[F.lit(seed + r) for r in range(ROUNDS)])

    def mixed(digit: Column, other: Column, key: Column, base: int) -> Column:
        return F.pmod(digit + F.pmod(F.xxhash64(key, other), F.lit(base)), F.lit(base))

    def once(place: Column) -> Column:
        start = F.struct(F.floor(place / b).cast("long").alias("left"),
                         F.pmod(place, F.lit(b)).cast("long").alias("right"))

        def step(digits: Column, key: Column) -> Column:
            left = mixed(digits["left"], digits["right"], key, a)
            return F.struct(left.cast("long").alias("left"),
                            mixed(digits["right"], left, key, b).cast("long").alias("right"))

        return F.aggregate(keys, start, step, lambda d: d["left"] * b + d["right"])

    outside = a * b - rows
    if not outside:
        return once(number)

    def walked(place: Column) -> Column:
        return F.when(place < rows, place).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.lit(outside)), place,
            lambda p, _: F.when(p < rows, p).otherwise(once(p))))

    return F.transform(F.array(once(number)), walked)[0]  # computed once, used twice


def numbered(rows: DataFrame, total: int, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Distinct rows with ``__copies`` and the first of their row numbers in ``__first``.

    Rows are dealt into buckets by a hash of all values and sorted inside a bucket;
    the numbers depend on the rows alone, never on how they are stored.
    """
    columns = rows.columns
    buckets = max(1, -(-total // per_bucket))
    counted = materialise(distinct_rows(rows).withColumn(
        "__bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets))), "numbers")
    starts = running_total(counted.groupBy("__bucket").agg(F.sum(COPIES).alias("__n")),
                           "__bucket", "__n", "__start")
    before = Window.partitionBy("__bucket").orderBy(*columns) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return counted.join(starts, "__bucket").withColumn(
        "__first", F.col("__start") + F.coalesce(F.sum(COPIES).over(before), F.lit(0))
    ).drop("__bucket", "__start")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, *, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, row_number, position, shard, slot`` for every row.

    Row counts of the shards differ by one at most; slots run from 0 without a gap.
    ``position`` is the permuted row number, ``shard`` its remainder and ``slot`` its
    quotient by the number of shards, so a reader can compute both.  A null text has
    size 1; rows equal in id, size and checksum get neighbouring row numbers; an empty
    table gives an empty result; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), (text_bytes(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    total = docs.count()
    each = repeated(numbered(rows, total), F.col(COPIES), "__index")
    return with_places(each.withColumn("row_number", F.col("__first") + F.col("__index")),
                       total, shards, seed) \
        .select("doc_id", "size", "text_crc32", "row_number", "position", "shard", "slot")


def with_places(df: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """Add ``position, shard, slot`` to rows with a ``row_number``."""
    return df.withColumn("position", permuted(F.col("row_number"), total, seed)) \
        .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")) \
        .withColumn("slot", F.floor(F.col("position") / shards).cast("long"))


def sharded_documents(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """All columns of the documents with ``shard`` and ``slot``.

    Row numbers are given to the keys of the rows; whole rows are then joined to them, so
    texts are shuffled once.  Equal rows take neighbouring row numbers.
    """
    rows, total = keyed(docs), docs.count()
    placed = take_copies(rows, numbered(rows.select(KEY), total), COPIES, "__index") \
        .withColumn("row_number", F.col("__first") + F.col("__index"))
    return with_places(placed, total, shards, seed) \
        .select(*unpacked(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]),
                "shard", "slot")
