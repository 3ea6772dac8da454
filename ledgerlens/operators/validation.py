"""Check report lines against the hits and the stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import excerpt, first_present, number_text

MESSAGE_ID = "ID: `([^`]*)`"
TRANSACTION_ID = "^\\n• [*][*]([^*]*)[*][*]"
TRANSACTION_NUMBERS = "SGD ([0-9.-]+)"
TRANSACTION_SCORE = "Risk: [*][*]([0-9.]+)/10"


def cited(lines: DataFrame, pattern: str) -> DataFrame:
    """``question_id, cited_id, line`` of the hit lines."""
    return lines.where("section = 2").select(
        "question_id", F.regexp_extract("line", pattern, 1).alias("cited_id"), "line")


def _verdict(checked: DataFrame, check: str, ok: Column) -> DataFrame:
    """One row per question: all of its lines pass."""
    return checked.groupBy("question_id").agg(
        F.lit(check).alias("check"), F.count("*").alias("checked"),
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))


def check_ids(lines: DataFrame, hits: DataFrame, record_id: str, pattern: str) -> DataFrame:
    """Every cited id is among the question's hits."""
    known = hits.select("question_id", F.col(record_id).alias("cited_id"),
                        F.lit(True).alias("known")).distinct()
    return _verdict(cited(lines, pattern).join(known, ["question_id", "cited_id"], "left"),
                    "ids", F.col("known"))


def unknown_ids(lines: DataFrame, hits: DataFrame, record_id: str, pattern: str) -> DataFrame:
    """The cited ids that are not hits."""
    known = hits.select("question_id", F.col(record_id).alias("cited_id"))
    return cited(lines, pattern).select("question_id", "cited_id") \
        .join(known, ["question_id", "cited_id"], "left_anti")


def check_counts(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """The claimed total is the number of hits."""
    claimed = lines.where("section = 1").select(
        "question_id", F.regexp_extract("line", "Total: ([0-9]+)", 1).cast("bigint").alias("n"))
    return _verdict(claimed.join(counts, "question_id", "left"), "counts",
                    F.col("n") == F.col("hit_count"))


def check_numbers(lines: DataFrame, transactions: DataFrame) -> DataFrame:
    """Amount and score of every transaction line equal the stored record's."""
    shown = cited(lines, TRANSACTION_ID).withColumns({
        "amount": F.nullif(F.regexp_extract("line", TRANSACTION_NUMBERS, 1), F.lit("")),
        "score": F.nullif(F.regexp_extract("line", TRANSACTION_SCORE, 1), F.lit("")),
    })
    actual = transactions.select(F.col("transaction_id").alias("cited_id"),
                                 number_text(F.col("amount_sgd")).alias("true_amount"),
                                 number_text(F.col("risk_score")).alias("true_score"))
    same = F.col("amount").eqNullSafe(F.col("true_amount")) \
        & F.col("score").eqNullSafe(F.col("true_score"))
    return _verdict(shown.join(actual, "cited_id", "left"), "numbers", same)


def check_masking(lines: DataFrame, messages: DataFrame) -> DataFrame:
    """The excerpt of every message line is that of the stored masked text."""
    label = "\n" + K.PII_EXCERPT
    place = F.instr("line", F.lit(label))
    shown = cited(lines, MESSAGE_ID).withColumn(
        "shown", F.when(place > 0, F.substr("line", place + len(label))).otherwise(""))
    text = first_present(F.col("masked_text"), F.col("original_text"))
    actual = messages.select(F.col("message_id").alias("cited_id"),
                             excerpt(text, K.PII_EXCERPT_CHARS).alias("stored"))
    return _verdict(shown.join(actual, "cited_id", "left"), "masking",
                    F.col("shown") == F.col("stored"))


def final_lines(lines: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Replace the report of a question that failed a check by the fixed sentence."""
    failed = verdicts.where(~F.col("ok")).select("question_id").distinct()
    fallback = failed.select(
        "question_id", F.lit(0).alias("section"), F.lit("").alias("ord"),
        F.lit(K.VALIDATION_FALLBACK).alias("line"))
    kept = lines.join(failed, "question_id", "left_anti")
    return kept.select(*fallback.columns).unionByName(fallback)
