"""Mix sources to target weights by dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.rows import (
    COPIES, KEY, distinct_rows, keyed, ranked, repeated, row_key, take_copies, unit_interval,
    unpacked)
from ledgerlens.sources.storage import materialise

SEED = 20_240_602
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
FOLD = 32  # rows that one step of the reduction tree rounds one after the other


def source_targets(counted: DataFrame, weights: Sequence[float], share: float,
                   most: float) -> DataFrame:
    """``source, source_rank, source_size, target, rows`` of every source.

    The target of a source is its weight times one common level, but ``most`` times its
    size at most.  The level starts at the share of all words per weight; what the
    sources at their limit leave over raises it until no further source reaches its
    limit.  Each step is one sum over the table of sources, which stays distributed.
    """
    sources = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col(COPIES)).alias("source_size"),
        F.count(F.lit(1)).alias("rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod("source_rank", F.lit(len(weights))) + 1).cast("int"))
    sources = materialise(ranked(sources, "source", "source_rank")
                          .withColumn("weight", weight), "sources")
    limit = most * F.col("source_size")
    size, weight_sum = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    words = share * (size or 0)
    level, full = (words / weight_sum if weight_sum else 0.0), -1
    while True:
        free = limit > F.col("weight") * level
        reached, used, left = sources.agg(
            F.count_if(~free), F.sum(F.when(free, 0.0).otherwise(limit)),
            F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        if reached == full or not left:
            break
        level, full = (words - used) / left, reached
    return sources.select("source", "source_rank", "source_size", "rows", F.least(
        F.col("weight") * level, limit).cast("double").alias("target"))


def _round_pair(seed: int, depth: int):
    """Fold step: move words between the carried row and the next until one is settled."""

    def step(state: Column, new: Column) -> Column:
        old = state["carry"]
        up = F.least(old["size"] - old["mass"], new["mass"])
        down = F.least(old["mass"], new["size"] - new["mass"])
        chance = unit_interval(F.lit(seed), F.lit(depth), old["doc_id"], old["key"],
                               new["doc_id"], new["key"])
        gain = chance * (up + down) < down  # the carried row gains, the new one loses
        fills = old["size"] - old["mass"] <= new["mass"]
        empties = old["mass"] <= new["size"] - new["mass"]
        both = old["mass"] + new["mass"]

        def settled(row: Column, take: int) -> Column:
            return _settled(row, F.lit(take))

        def carried(row: Column, mass: Column) -> Column:
            return row.withField("mass", mass)

        def case(carry: Column, done: Column) -> Column:
            return F.struct(carry.alias("carry"),
                            F.concat(state["done"], F.array(done)).alias("done"))

        return F.when(gain & fills, case(carried(new, both - old["size"]), settled(old, 1))) \
            .when(gain, case(carried(old, both), settled(new, 0))) \
            .when(empties, case(carried(new, both), settled(old, 0))) \
            .otherwise(case(carried(old, both - new["size"]), settled(new, 1)))

    return step


def _settled(row: Column, take: Column) -> Column:
    return F.struct(*[row[c].alias(c) for c in ("doc_id", "key", "size", "copies", "whole")],
                    take.cast("int").alias("take"))


def pivotal(items: DataFrame, widest: int, seed: int = SEED) -> DataFrame:
    """Round the word mass of each row to none or all of its size.

    ``items`` has ``source_rank, bucket`` and ``item`` (``doc_id, key, size, copies, whole,
    mass``).  A group of neighbouring buckets is folded pair by pair: words move from one
    row to the other, upwards or downwards with chances that keep both expectations, until
    one row is settled.  Long rows come first, so that the row left over, which goes up the
    tree to the next, larger group, is mostly a short one.  The
    words of a source therefore change by less than one row in all.  ``widest`` is the
    largest number of buckets of a source.
    """
    settled, depth = None, 0
    level, buckets = items, widest
    while True:
        groups = level.groupBy("source_rank", "bucket").agg(
            F.array_sort(F.collect_list(F.struct(
                (-F.col("item.size")).alias("s"),
                F.xxhash64(F.lit(seed), "item.doc_id", "item.key").alias("h"), "item")))
            .alias("all")).withColumn("all", F.transform("all", lambda x: x["item"]))
        done = F.filter(F.array(_settled(F.col("all")[0], F.lit(0))), lambda _: F.lit(False))
        folded = materialise(groups.select("source_rank", "bucket", F.aggregate(
            F.expr("slice(all, 2, size(all))"),
            F.struct(F.col("all")[0].alias("carry"), done.alias("done")),
            _round_pair(seed, depth)).alias("f")), "rounding")
        part = folded.select("source_rank", F.explode("f.done").alias("d"))
        settled = part if settled is None else settled.unionByName(part)
        rest = folded.select("source_rank", "bucket", F.col("f.carry").alias("item"))
        if buckets <= 1:
            break
        level = rest.withColumn("bucket", F.floor(F.col("bucket") / FOLD).cast("long"))
        buckets, depth = -(-buckets // FOLD), depth + 1
    item = F.col("item")
    take = unit_interval(F.lit(seed), F.lit(-1), item["doc_id"], item["key"]) \
        * item["size"] < item["mass"]
    last = rest.select("source_rank", _settled(item, take).alias("d"))
    return settled.unionByName(last).select("source_rank", "d.*")


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: float = MOST, seed: int = SEED, id_column: str = "doc_id",
        text_column: str = "text", source_column: str = "source",
        key: Column | None = None) -> DataFrame:
    """How often the mix takes each distinct row.

    One row for rows equal in id, source, size and key (the text's checksum, or the one
    given): ``doc_id, key, source, size, source_size, target, __copies`` (equal rows),
    ``base`` (copies that each of them gives) and ``extra`` (how many of them give one
    more).  All rows of a source share one rate, its target by its size; the whole part of
    the rate is given to all, the rest is rounded by ``pivotal``.  Equal rows are
    interchangeable and are rounded together up to one of them.  A row without words has
    nothing to balance and gets the whole part only.  Null is a source of its own; an empty
    table gives an empty result; other columns are ignored.
    """
    text = F.col(text_column)
    key = F.crc32(F.coalesce(text, F.lit("")).cast("binary")) if key is None else key
    counted = materialise(distinct_rows(docs.select(
        F.col(id_column).alias("doc_id"), key.alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source_column).alias("source"))), "sizes")
    sources = materialise(source_targets(counted, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.withColumn("base", F.floor(rate).cast("long")) \
        .withColumn("part", rate - F.col("base"))
    mass = F.when(F.col("size") > 0, F.col("part") * F.col(COPIES)).otherwise(0.0)
    ready = counted.join(plan.withColumnRenamed("source", "__source"),
                         F.col("source").eqNullSafe(F.col("__source"))) \
        .withColumn("whole", F.floor(mass).cast("long")) \
        .withColumn("mass", (mass - F.col("whole")) * F.col("size"))
    buckets = F.ceil(F.col("rows") / FOLD)
    items = ready.where("mass > 0").select(
        "source_rank", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key"), buckets).alias("bucket"),
        F.struct("doc_id", "key", "size", F.col(COPIES).alias("copies"), "whole", "mass")
        .alias("item"))
    widest = sources.agg(F.max(buckets)).first()[0] or 1
    rounded = pivotal(items, widest, seed).join(plan, "source_rank") \
        .withColumn(COPIES, F.col("copies")).withColumn("extra", F.col("whole") + F.col("take"))
    plain = ready.where("mass = 0").withColumn("extra", F.col("whole"))
    out = ["doc_id", "key", "source", "size", "source_size", "target", COPIES, "base", "extra"]
    return plain.select(*out).unionByName(rounded.select(*out))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row."""
    copies = F.col("base") + (F.col("__index") < F.col("extra")).cast("long")
    return repeated(mix(docs, **options), F.col(COPIES), "__index") \
        .withColumn("copies", copies).select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix has them: each row as often as it is taken."""
    decided = mix(docs, key=row_key(docs), **options).select(
        F.col("key").alias(KEY), COPIES,
        (F.col("base") * F.col(COPIES) + F.col("extra")).alias("__take"))
    return take_copies(keyed(docs), decided, "__take", "__index") \
        .select(*unpacked(*docs.columns))
