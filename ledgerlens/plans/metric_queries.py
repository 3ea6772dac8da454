"""Metric, profile and readiness queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens import constants as K
from ledgerlens.operators import metrics as M, reports as R, search as S
from ledgerlens.plans import sql_views as Q
from ledgerlens.plans.registry import query
from ledgerlens.plans.search_queries import MESSAGE_MATCH
from ledgerlens.plans.tagging_queries import AS_OF, EXTENDED_SQL
from ledgerlens.sources import views
from ledgerlens.sources.storage import regrouped


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 4))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.obligations(spark, sf_dir, with_text=False)


AML_SQL = """SELECT 'aml_high_risk_count' AS metric, '' AS label,
    CAST(count(*) FILTER (WHERE risk_score > 8) AS DOUBLE) AS value FROM txn
UNION ALL SELECT 'avg_risk_score', '', round(avg(risk_score), 4) FROM txn"""
PII_SQL = """SELECT 'pii_critical_count' AS metric, '' AS label,
    CAST(count(*) FILTER (WHERE lower(risk_flag) = 'critical') AS DOUBLE) AS value
FROM tagged_up"""
REG_SQL = """SELECT 'reg_total_paragraphs' AS metric, '' AS label,
    CAST(count(*) AS DOUBLE) AS value FROM oblig"""


def _breakdown(metric: str, column: str) -> str:
    return (f"SELECT '{metric}' AS metric, coalesce({column}, '(missing)') AS label, "
            f"CAST(count(*) AS DOUBLE) AS value FROM oblig GROUP BY {column}")


BREAKDOWN_SQL = {column: _breakdown(metric, column) for metric, column in M.REG_BREAKDOWNS}
ALL_SQL = " UNION ALL ".join([AML_SQL, PII_SQL, REG_SQL, *BREAKDOWN_SQL.values()])


@query(Q.views("txn") + AML_SQL)
def metric_aml_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.transaction_metrics(views.tagged_transactions(spark, sf_dir)))


@query(Q.views("tagged") + PII_SQL)
def metric_pii_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.message_metrics(views.tagged_messages_upgraded(spark, sf_dir))


@query(Q.views("oblig") + REG_SQL)
def metric_reg_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.obligation_total(_metadata(spark, sf_dir))


@query(Q.views("oblig") + BREAKDOWN_SQL["owner"])
def metric_reg_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.obligation_breakdowns(_metadata(spark, sf_dir), "owner")


@query(Q.views("oblig") + BREAKDOWN_SQL["source_document"])
def metric_reg_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.obligation_breakdowns(_metadata(spark, sf_dir), "source_document")


@query(Q.views("oblig") + BREAKDOWN_SQL["risk_type"])
def metric_reg_risk_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.obligation_breakdowns(_metadata(spark, sf_dir), "risk_type")


@query(Q.views("txn") + """SELECT count(*) AS records,
    count(*) FILTER (WHERE risk_score >= 8) AS high_risk FROM txn""")
def metric_aml_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transaction_log(views.tagged_transactions(spark, sf_dir))


@query(Q.views("oblig") + f"SELECT metric, '' AS label, value FROM ({EXTENDED_SQL})")
def metric_reg_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extended_obligation_metrics(_metadata(spark, sf_dir), AS_OF)


@query(Q.views("tagged", "txn", "oblig") + ALL_SQL)
def semantic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.semantic_metrics(
        transactions=views.tagged_transactions(spark, sf_dir),
        messages=views.tagged_messages_upgraded(spark, sf_dir),
        obligations=_metadata(spark, sf_dir)))


@query(Q.views("tagged", "txn", "oblig") + ALL_SQL + """
UNION ALL SELECT 'vector_count', '', CAST(count(*) AS DOUBLE) FROM embeddings""")
def semantic_metrics_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.hybrid_metrics(
        views.vectors(spark, sf_dir),
        transactions=views.tagged_transactions(spark, sf_dir),
        messages=views.tagged_messages_upgraded(spark, sf_dir),
        obligations=_metadata(spark, sf_dir)))


@query(Q.views("tagged") + "SELECT risk_flag, count(*) AS n FROM tagged_up GROUP BY risk_flag")
def profile_risk_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_counts(views.tagged_messages_upgraded(spark, sf_dir), "risk_flag")


@query(Q.views("oblig") + "SELECT owner, count(*) AS n FROM oblig WHERE owner IS NOT NULL GROUP BY owner")
def profile_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_counts(_metadata(spark, sf_dir), "owner")


@query("SELECT source AS source_document, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def profile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.value_counts(views.paragraphs(spark, sf_dir), "source_document")


@query(Q.views("tagged") + """
SELECT label, count(*) AS n FROM (SELECT unnest(string_split(entities, '|')) AS label FROM tagged)
WHERE label <> '' GROUP BY label ORDER BY n DESC, label LIMIT 15""")
def top_pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_counts(views.tagged_messages(spark, sf_dir), "pii_entities")


@query(Q.views("txn") + """
SELECT label, count(*) AS n FROM (SELECT unnest(string_split(tags, '|')) AS label FROM txn)
GROUP BY label ORDER BY n DESC, label LIMIT 15""")
def top_aml_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_counts(views.tagged_transactions(spark, sf_dir), "aml_tags")


@query(Q.views("txn") + """
SELECT bin, bin * 1.0::DOUBLE AS bin_start, n FROM (
    SELECT CAST(least(floor(risk_score), 9) AS INTEGER) AS bin, count(*) AS n
    FROM txn WHERE risk_score BETWEEN 0 AND 10 GROUP BY bin)""")
def aml_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_histogram(views.tagged_transactions(spark, sf_dir))


@query(Q.views("tagged", "golden", "passages") + f""",
asked AS (SELECT question_id, lower({Q.strip('text')}) AS q FROM
    (SELECT question_id, text FROM golden UNION ALL SELECT question_id, text FROM passages))
SELECT question_id, count(*) AS total,
    count(*) FILTER (WHERE risk_flag = 'Critical') AS critical,
    count(*) FILTER (WHERE risk_flag = 'High') AS high,
    count(*) FILTER (WHERE risk_flag = 'Medium') AS medium,
    count(*) FILTER (WHERE risk_flag = 'Low') AS low
FROM asked JOIN tagged_up ON {MESSAGE_MATCH} GROUP BY question_id""")
def pii_result_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk distribution of each question's result set."""
    asked = views.golden_questions(spark).unionByName(views.passages(spark, sf_dir))
    keys = S.message_keys(asked)
    hits = S.match_messages(views.corpus(spark, sf_dir, [K.PII_SEARCH]).tagged_messages, keys)
    per_key = M.risk_summary(hits, "search_key")
    return S.per_question(keys, regrouped(per_key, "search_key"))


_TOPIC = Q.views("oblig", "topic")


@query(_TOPIC + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE NOT {Q.missing('deadline')}) AS with_deadline,
    count(*) FILTER (WHERE {Q.missing('deadline')}) AS without_deadline FROM topic""")
def reg_deadline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.deadline_coverage(views.TABLE_TOPIC.rows(_metadata(spark, sf_dir)))


@query(_TOPIC + f"""
SELECT count(*) AS total,
    count(*) FILTER (WHERE {Q.missing('owner')} OR {Q.missing('deadline')}) AS missing_count,
    count(*) FILTER (WHERE NOT ({Q.missing('owner')} OR {Q.missing('deadline')}))
        AS complete_count FROM topic""")
def reg_missing_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.missing_split(views.TABLE_TOPIC.rows(_metadata(spark, sf_dir)))


def _example_columns() -> str:
    return ("paragraph_id, substring(regulation, 1, 160) AS excerpt, "
            f"CASE WHEN {Q.missing('owner')} THEN '(missing)' ELSE owner END AS owner, "
            f"CASE WHEN {Q.missing('deadline')} THEN '(missing)' ELSE deadline END AS deadline")


@query(_TOPIC + f"""
SELECT * FROM (SELECT 'coverage' AS kind, {_example_columns()} FROM topic
    ORDER BY paragraph_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'missing' AS kind, {_example_columns()} FROM topic
    WHERE {Q.missing('owner')} OR {Q.missing('deadline')} ORDER BY paragraph_id LIMIT 5)""")
def reg_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.TABLE_TOPIC.rows(_metadata(spark, sf_dir))
    lacking = rows.where(M.lacks_owner_or_deadline())
    return R.obligation_examples(rows, K.COVERAGE_ROWS).withColumn("kind", F.lit("coverage")) \
        .unionByName(R.obligation_examples(lacking, K.MISSING_ROWS)
                     .withColumn("kind", F.lit("missing")))


@query("""SELECT event_type, 'k' AS label, sum(CAST(props::JSON->>'k' AS BIGINT))::BIGINT AS n
FROM events GROUP BY event_type""")
def breakdown_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON maps of the events, merged into one breakdown per event type."""
    parsed = M.parse_breakdown(views.table(spark, sf_dir, "events"), "props", "event_type")
    return M.merge_breakdowns(parsed, "event_type")


@query(Q.views("tagged", "txn", "oblig") + """
SELECT 'tagged_pii' AS table_name, count(*) AS records, count(masked_text) AS usable,
    count(*) - count(masked_text) AS unusable, count(masked_text) > 0 AS ready FROM tagged
UNION ALL SELECT 'tagged_aml', count(*), count(narrative), count(*) - count(narrative),
    count(narrative) > 0 FROM txn
UNION ALL SELECT 'tagged_reg', count(*), count(owner), count(*) - count(owner),
    count(owner) > 0 FROM oblig
UNION ALL SELECT 'vectors', count(*), count(embedding), count(*) - count(embedding),
    count(embedding) > 0 FROM embeddings""")
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.readiness({
        "tagged_pii": (views.tagged_messages(spark, sf_dir), "masked_text"),
        "tagged_aml": (views.tagged_transactions(spark, sf_dir), "masked_narrative"),
        "tagged_reg": (_metadata(spark, sf_dir), "owner"),
        "vectors": (views.vectors(spark, sf_dir), "vector"),
    })
