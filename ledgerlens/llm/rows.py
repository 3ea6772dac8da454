"""Helpers on rows that several operators share; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.sources.storage import materialise

COPIES = "__copies"
KEY = "__key"
ROW = "__row"
CHUNK = 1 << 16


def unused(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unit_interval(*parts: Column) -> Column:
    """A reproducible number in [0, 1) for the given values."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Equal rows once, with their number in ``__copies``.

    Equal rows are combined in each task before the shuffle, so a row that a
    third of the table repeats costs one row per task.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def repeated(df: DataFrame, times: Column, index: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``index``; no long array is built."""
    spread = df.withColumn("__times", times.cast("long")).where("__times > 0") \
        .withColumn("__chunk", F.explode(F.sequence(
            F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / CHUNK))))
    low = F.col("__chunk") * CHUNK
    return spread.withColumn(index, F.explode(F.sequence(
        low, F.least(low + CHUNK, F.col("__times")) - 1))).drop("__times", "__chunk")


def running_total(counts: DataFrame, key: str, amount: str, total: str,
                  group: int = 4096) -> DataFrame:
    """``key`` (numbered from 0) with the sum of ``amount`` over all smaller keys.

    Two levels: sums of ``group`` neighbouring keys, then inside each group, so the
    only window without a partition has one row per group.
    """
    grouped = counts.withColumn("__group", F.floor(F.col(key) / group))
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    heads = grouped.groupBy("__group").agg(F.sum(amount).alias("__sum")) \
        .select("__group", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__head"))
    inside = Window.partitionBy("__group").orderBy(key) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(heads, "__group").select(
        key, (F.col("__head") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).alias(total))


def ranked(df: DataFrame, column: str, rank: str) -> DataFrame:
    """Number distinct values from 0 in ascending order, null last.

    Sorted ranges are written once, so that the cuts between them stay fixed; the
    numbers follow from the sizes of the ranges.
    """
    order = F.col(column).asc_nulls_last()
    parts = materialise(
        df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    starts = running_total(parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")),
                           "__part", "__n", "__start")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.join(starts, "__part") \
        .withColumn(rank, (F.col("__start") + place).cast("long")).drop("__part", "__start")


def row_key(df: DataFrame) -> Column:
    """A key of all values of a row; equal rows have equal keys."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def keyed(df: DataFrame) -> DataFrame:
    """Whole rows as one struct, ``ROW``, with their key.

    The table's own names lie inside the struct and clash with none that are added.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW),
                     row_key(df).alias(KEY))


def unpacked(*names: str) -> list[Column]:
    """The named columns of packed rows."""
    return [F.col(f"{ROW}.`{c}`") for c in names]


def take_copies(rows: DataFrame, decided: DataFrame, times: str, index: str) -> DataFrame:
    """Whole rows by a decision on narrow ones.

    ``rows`` come from ``keyed``; ``decided`` has one row for each distinct key, with
    ``__copies`` and how often the key is kept in ``times``.  A key that several equal
    rows share is first reduced to one of them, so no group of equal rows meets in a task.
    """
    columns = rows.columns
    single = rows.join(decided.where(F.col(COPIES) == 1), KEY)
    several = decided.where(F.col(COPIES) > 1)
    first = rows.join(several.select(KEY), KEY, "left_semi").dropDuplicates([KEY])
    both = single.unionByName(first.select(*columns).join(several, KEY))
    return repeated(both, F.col(times), index)
