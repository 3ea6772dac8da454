"""One key with nearly all rows is split by every join that hands out results by key."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M, search as S
from ledgerlens.operators.answers import Found
from ledgerlens.sources.storage import materialise, regrouped

ROWS = 40_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture()
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, name):
    """``question_id`` and a key that 95 of 100 questions share."""
    key = F.when(F.col("id") % 100 < 95, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return materialise(spark.range(ROWS).repartition(8).select(
        F.concat(F.lit("q"), "id").alias("question_id"), key.alias(name)), "hot")


def hits(spark):
    return materialise(spark.range(2000).select(
        F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        .alias("search_key"), F.col("id").cast("string").alias("message_id"),
        F.lit("High").alias("risk_flag")), "hits")


def largest_share(df):
    """Part of all rows in the largest task of the last join."""
    counts = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in counts) / sum(r["count"] for r in counts)


def was_split(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def found(spark):
    members = hot(spark, "set_id")
    keys = members.select(F.col("set_id").alias("question_id")).distinct() \
        .withColumn("search_key", F.col("question_id"))
    return Found(materialise(keys, "keys"), members, hits(spark), "message_id",
                 [F.asc("message_id")])


def test_counts_reach_all_questions_of_one_set(spark, splitting):
    one = found(spark)
    spread = one.spread(S.counts_per_question(one.keys, one.hits))
    assert was_split(spread) and largest_share(spread) < 0.25
    assert spread.count() == ROWS


def test_counts_of_one_key(spark, splitting):
    keys = hot(spark, "search_key")
    per_key = regrouped(hits(spark).groupBy("search_key").agg(F.count("*").alias("n")),
                        "search_key")
    assert largest_share(keys.join(per_key, "search_key", "left")) < 0.25
    counted = S.counts_per_question(keys, hits(spark))
    assert was_split(counted) and counted.count() == ROWS


def test_first_hits_of_one_key(spark, splitting):
    top = S.top_per_question(hot(spark, "search_key"), hits(spark), [F.asc("message_id")], 2)
    assert was_split(top) and top.count() >= 2 * ROWS * 95 // 100


def test_risk_of_one_key(spark, splitting):
    summary = S.per_question(hot(spark, "search_key"),
                             regrouped(M.risk_summary(hits(spark), "search_key"), "search_key"))
    assert was_split(summary) and largest_share(summary) < 0.25
