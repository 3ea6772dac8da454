"""Semantic metrics, breakdowns, profiles and readiness counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.lists import parse_list
from ledgerlens.functions.text import is_missing, strip

METRIC_COLUMNS = ("metric", "label", "value")


def _scalars(df: DataFrame, metrics: list[tuple[str, Column]]) -> DataFrame:
    """One aggregate pass, one row per metric; no rows for an empty input."""
    one = df.agg(F.count("*").alias("rows"),
                 *[value.cast("double").alias(name) for name, value in metrics]) \
        .where("rows > 0")
    rows = F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.lit("").alias("label"),
                 F.col(name).alias("value")) for name, _ in metrics]))
    return one.select(rows)


def _breakdowns(df: DataFrame, metrics: list[tuple[str, str]],
                total: str | None = None) -> DataFrame:
    """Counts per label of several columns in one pass; null is the label '(missing)'.

    ``total`` names a metric that counts all rows in the same pass.
    """
    rows = [F.struct(F.lit(metric).alias("metric"),
                     F.coalesce(F.col(column).cast("string"), F.lit(K.MISSING)).alias("label"))
            for metric, column in metrics]
    if total is not None:
        rows.append(F.struct(F.lit(total).alias("metric"), F.lit("").alias("label")))
    return df.select(F.inline(F.array(*rows))).groupBy("metric", "label") \
        .agg(F.count("*").cast("double").alias("value"))


def transaction_metrics(tagged: DataFrame, threshold: float = 8.0) -> DataFrame:
    """High-risk count above the threshold, and the mean score with nulls skipped."""
    score = F.col("risk_score")
    return _scalars(tagged, [
        ("aml_high_risk_count", F.count_if(score > threshold)),
        ("avg_risk_score", F.avg(score)),
    ])


def transaction_log(tagged: DataFrame, threshold: float = 8.0) -> DataFrame:
    """Record and high-risk counts of the tagging log; here the threshold is inclusive."""
    return tagged.agg(F.count("*").alias("records"),
                      F.count_if(F.col("risk_score") >= threshold).alias("high_risk"))


def message_metrics(tagged: DataFrame) -> DataFrame:
    critical = F.lower("risk_flag") == K.RISK_LEVELS[3].lower()
    return _scalars(tagged, [("pii_critical_count", F.count_if(critical))])


REG_TOTAL = "reg_total_paragraphs"
REG_BREAKDOWNS = (
    ("reg_owner_breakdown", "owner"),
    ("reg_doc_breakdown", "source_document"),
    ("reg_risk_type_breakdown", "risk_type"),
)


def obligation_total(tagged: DataFrame) -> DataFrame:
    return _scalars(tagged, [(REG_TOTAL, F.count("*"))])


def _existing_breakdowns(tagged: DataFrame) -> list[tuple[str, str]]:
    return [(metric, column) for metric, column in REG_BREAKDOWNS if column in tagged.columns]


def obligation_breakdowns(tagged: DataFrame, *columns: str) -> DataFrame:
    """Counts per owner, document and risk type, for the columns that exist."""
    return _breakdowns(tagged, [(metric, column) for metric, column in _existing_breakdowns(tagged)
                                if not columns or column in columns])


def obligation_metrics(tagged: DataFrame) -> DataFrame:
    """Total and all breakdowns in one pass."""
    return _breakdowns(tagged, _existing_breakdowns(tagged), REG_TOTAL)


def semantic_metrics(transactions: DataFrame | None = None, messages: DataFrame | None = None,
                     obligations: DataFrame | None = None) -> DataFrame:
    """All metrics as ``metric, label, value``; a missing or empty domain gives no rows."""
    parts: list[DataFrame] = []
    if transactions is not None and "risk_score" in transactions.columns:
        parts.append(transaction_metrics(transactions))
    if messages is not None and "risk_flag" in messages.columns:
        parts.append(message_metrics(messages))
    if obligations is not None:
        parts.append(obligation_metrics(obligations))
    if not parts:
        raise ValueError("no domain to measure")
    return reduce(DataFrame.unionByName, parts)


def hybrid_metrics(vectors: DataFrame, **domains: DataFrame) -> DataFrame:
    """Semantic metrics plus the size of the vector table."""
    return semantic_metrics(**domains).unionByName(
        _scalars(vectors, [("vector_count", F.count("*"))]))


def extended_obligation_metrics(tagged: DataFrame, as_of: str) -> DataFrame:
    """Totals, distinct documents and owners, deadline coverage and overdue count.

    Only ISO dates can be overdue; free text deadlines never are.
    """
    due = F.try_to_date(F.when(F.col("deadline").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
                               F.col("deadline")), "yyyy-MM-dd")
    owner = F.when(~is_missing(F.col("owner")), F.col("owner"))
    return _scalars(tagged, [
        ("reg_total_obligations", F.count("*")),
        ("reg_unique_documents", F.count_distinct("source_document")),
        ("reg_unique_owners", F.count_distinct(owner)),
        ("reg_with_deadline", F.count_if(~is_missing(F.col("deadline")))),
        ("reg_overdue_obligations", F.count_if(due < F.to_date(F.lit(as_of)))),
        ("reg_missing_owner", F.count_if(is_missing(F.col("owner")))),
    ])


def deadline_coverage(obligations: DataFrame) -> DataFrame:
    missing = is_missing(F.col("deadline"))
    return obligations.agg(
        F.count("*").alias("total"),
        F.count_if(~missing).alias("with_deadline"),
        F.count_if(missing).alias("without_deadline"),
    )


def lacks_owner_or_deadline() -> Column:
    return is_missing(F.col("owner")) | is_missing(F.col("deadline"))


def missing_split(obligations: DataFrame) -> DataFrame:
    lacking = lacks_owner_or_deadline()
    return obligations.agg(
        F.count("*").alias("total"),
        F.count_if(lacking).alias("missing_count"),
        F.count_if(~lacking).alias("complete_count"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, nulls dropped, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(column) \
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def label_counts(df: DataFrame, column: str, label: str = "label",
                 n: int | None = K.TOP_LABELS) -> DataFrame:
    """Occurrences of each label of a list column, most frequent first.

    A text column is parsed as a list first, without splitting on commas.
    """
    if column not in df.columns:
        return df.select(F.lit("").alias(label), F.lit(0).cast("bigint").alias("n")).limit(0)
    items = F.col(column)
    if not df.schema[column].dataType.simpleString().startswith("array"):
        items = parse_list(items, split_commas=False, strip_quotes=True)
    counts = (
        df.select(F.explode(items).alias(label))
        .select(F.regexp_replace(strip(F.col(label)), "^['\"]+|['\"]+$", "").alias(label))
        .where(F.col(label) != "")
        .groupBy(label).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), label)
    )
    return counts if n is None else counts.limit(n)


def score_histogram(df: DataFrame, column: str = "risk_score", low: float = 0.0,
                    high: float = 10.0, bins: int = 10) -> DataFrame:
    """Counts per equal-width bin; the top edge belongs to the last bin."""
    width = (high - low) / bins
    number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    return (
        df.where(F.col(column).between(low, high))
        .groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
        .select("bin", (F.col("bin") * width + low).alias("bin_start"), "n")
    )


def parse_breakdown(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Rows ``keep..., label, n`` from a JSON map column; single quotes are accepted."""
    text = strip(F.col(column))
    valid = F.when(text.startswith("{") & text.endswith("}"), F.translate(text, "'", '"'))
    return df.select(*keep, F.explode(F.from_json(valid, "map<string,bigint>"))
                     .alias("label", "n")).where("n is not null")


def merge_breakdowns(parsed: DataFrame, *keys: str) -> DataFrame:
    """Total per label, largest first."""
    return parsed.groupBy(*keys, "label").agg(F.sum("n").alias("n")) \
        .orderBy(*keys, F.desc("n"), "label")


def risk_summary(hits: DataFrame, group: str = "question_id") -> DataFrame:
    """Hits per group in total and by risk level."""
    risk = F.initcap(F.lower("risk_flag"))
    return hits.groupBy(group).agg(
        F.count("*").alias("total"),
        *[F.count_if(risk == level).alias(level.lower()) for level in reversed(K.RISK_LEVELS)],
    )


def narrative_quality(tagged: DataFrame, column: str = "masked_narrative") -> DataFrame:
    """Null and near-empty narratives."""
    text = F.col(column)
    return tagged.agg(
        F.count("*").alias("records"),
        F.count_if(text.isNull()).alias("null_narratives"),
        F.count_if(F.length(text) <= 1).alias("short_narratives"),
    )


def readiness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, usable and unusable values of one key column per table, with a ready flag."""
    parts = [
        df.select(F.col(column).alias("v")).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("records"),
            F.count("v").alias("usable"),
            F.count_if(F.col("v").isNull()).alias("unusable"),
        ) for name, (df, column) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("ready", F.col("usable") > 0)
