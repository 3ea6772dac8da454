"""Tagging, risk, routing and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens import constants as K
from ledgerlens.functions import intents, risk, text as T
from ledgerlens.functions.detectors import TABLES, mask_text as masked
from ledgerlens.functions.lists import parse_list
from ledgerlens.operators import tagging, vectors as V
from ledgerlens.operators.metrics import (
    extended_obligation_metrics, narrative_quality)
from ledgerlens.operators.reports import owner_or_units
from ledgerlens.plans import sql_views as Q
from ledgerlens.plans.registry import query
from ledgerlens.sources import views
from ledgerlens.sources.storage import master_export


def _bar(column: str):
    return F.array_join(column, "|")


@query(Q.views("tagged") + """
SELECT message_id, entities AS pii_entities, first_risk AS risk_flag,
       CAST(length(masked_text) AS INTEGER) AS masked_length, md5(masked_text) AS masked_md5,
       CAST(length(original_text) AS INTEGER) AS original_length FROM tagged""")
def pii_tag_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tagged_messages(spark, sf_dir).select(
        "message_id", _bar("pii_entities").alias("pii_entities"), "risk_flag",
        F.length("masked_text").alias("masked_length"), F.md5("masked_text").alias("masked_md5"),
        F.length("original_text").alias("original_length"))


@query(Q.views("tagged") + """
SELECT message_id, masked_text FROM tagged""")
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(views.messages(spark, sf_dir), "text", TABLES).select(
        "message_id", "masked_text")


def _typologies() -> str:
    tag, word, low, high = K.TABLE_AMOUNT_BAND
    flags = {}
    for name, pattern, weight in K.TABLE_TYPOLOGIES:
        flag = f"regexp_matches(n, {Q.quote(pattern)})"
        if name == tag:
            flag = f"({flag} OR (contains(n, '{word}') AND amount_sgd >= {low} AND amount_sgd < {high}))"
        flags[name] = (flag, weight)
    step = "CASE " + " ".join(f"WHEN amount_sgd >= {a} THEN {p}" for a, p in K.TABLE_AMOUNT_STEPS) \
        + " ELSE 0 END"
    score = " + ".join(f"CASE WHEN {f} THEN {w} ELSE 0 END" for f, w in flags.values())
    tags = ", ".join(f"CASE WHEN {f} THEN '{n}' END" for n, (f, _) in flags.items())
    reasons = ", ".join(f"CASE WHEN {f} THEN '{n} +{w}' END" for n, (f, w) in flags.items())
    return f"""SELECT transaction_id, narrative AS masked_narrative, '' AS pii_found,
        concat_ws('|', {tags}) AS aml_tags,
        CAST(least(10, 1 + {step} + {score}) AS DOUBLE) AS risk_score,
        coalesce(nullif(concat_ws(', ', {reasons},
            CASE WHEN {step} > 0 THEN 'amount +' || ({step}) END), ''),
            'no typology found') AS explanation, amount_sgd, date
        FROM (SELECT *, lower(narrative) AS n FROM txn)"""


@query(Q.views("txn") + _typologies())
def aml_tag_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagging.tag_transactions(views.transactions(spark, sf_dir),
                                      tagging.TABLE_TRANSACTIONS, TABLES)
    return tagged.select(
        "transaction_id", "masked_narrative", _bar("pii_found").alias("pii_found"),
        _bar("aml_tags").alias("aml_tags"), "risk_score", "explanation", "amount_sgd", "date")


def _obligation_rules() -> str:
    def chain(rules, default):
        return "CASE " + " ".join(f"WHEN regexp_matches(t, {Q.quote(p)}) THEN '{label}'"
                                  for p, label in rules) + f" ELSE {default} END"
    units = ", ".join(f"CASE WHEN regexp_matches(t, {Q.quote(p)}) THEN '{u}' END"
                      for p, u in K.TABLE_BUSINESS_UNIT_RULES)
    return f"""SELECT CAST(doc_id AS VARCHAR) AS paragraph_id, source AS source_document,
        source AS regulation, CAST(NULL AS VARCHAR) AS article,
        {chain(K.TABLE_RISK_TYPE_RULES, "'" + K.DEFAULT_RISK_TYPE + "'")} AS risk_type,
        concat_ws('|', {units}) AS business_unit,
        {chain(K.TABLE_OWNER_RULES, "'" + K.DEFAULT_OWNER + "'")} AS owner,
        coalesce(nullif(regexp_extract(t, {Q.quote(K.TABLE_DEADLINE_PERIOD)}, 1), ''),
            {chain(K.TABLE_DEADLINE_RULES, 'NULL')}) AS deadline,
        CAST(length(text) AS INTEGER) AS text_length
        FROM (SELECT *, lower(text) AS t FROM documents)"""


@query(_obligation_rules())
def reg_tag_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagging.tag_obligations(views.paragraphs(spark, sf_dir), tagging.TABLE_OBLIGATIONS)
    return tagged.select(
        "paragraph_id", "source_document", "regulation", "article", "risk_type",
        _bar("business_unit").alias("business_unit"), "owner", "deadline",
        F.length("original_text").alias("text_length"))


@query(Q.views("tagged") + """
SELECT message_id, concat_ws('|', CASE WHEN contains(entities, 'ACCOUNT') THEN 'Account' END,
    CASE WHEN contains(entities, 'PHONE') THEN 'Phone' END,
    CASE WHEN contains(entities, 'EMAIL') THEN 'Email' END) AS types FROM tagged""")
def pii_canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tagged_messages(spark, sf_dir).select(
        "message_id",
        F.array_join(risk.canonical_types(F.col("pii_entities")), "|").alias("types"))


@query(Q.views("tagged") + f""",
prior AS (SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN toxic = 1 THEN 'High'
    WHEN quality = 0 THEN 'Medium' ELSE 'Low' END AS prior FROM labels)
SELECT t.message_id, entities AS pii_entities, {Q.upgraded('entities', 'prior')} AS risk_flag
FROM tagged t LEFT JOIN prior p ON t.message_id = p.message_id""")
def pii_risk_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    upgraded = tagging.upgrade_risk(views.messages_with_prior(spark, sf_dir))
    return upgraded.select("message_id", _bar("pii_entities").alias("pii_entities"), "risk_flag")


@query(Q.views("tagged") + """
SELECT risk_flag, count(*) AS n FROM tagged_up GROUP BY risk_flag""")
def pii_risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detect, mask, score, upgrade and count by risk."""
    tagged = tagging.upgrade_risk(views.tagged_messages(spark, sf_dir))
    return tagged.groupBy("risk_flag").agg(F.count("*").alias("n"))


@query(Q.views("tagged") + """
SELECT message_id, lower(risk_flag) IN ('high', 'critical') AS highlighted FROM tagged_up""")
def pii_highlight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tagging.upgrade_risk(views.tagged_messages(spark, sf_dir))
    return tagged.select("message_id", risk.is_highlighted(F.col("risk_flag")).alias("highlighted"))


@query(Q.views("txn") + f"""
SELECT transaction_id AS id, {Q.strip("replace(coalesce(narrative, ''), chr(0), ' ')")} AS text
FROM txn WHERE length({Q.strip("replace(coalesce(narrative, ''), chr(0), ' ')")}) > 0""")
def vec_text_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vector_text(views.tagged_transactions(spark, sf_dir))


@query(Q.views("txn") + """
SELECT count(*) AS records, count(*) FILTER (WHERE narrative IS NULL) AS null_narratives,
    count(*) FILTER (WHERE length(narrative) <= 1) AS short_narratives FROM txn""")
def dq_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative_quality(views.tagged_transactions(spark, sf_dir))


@query(f"""SELECT doc_id, {Q.excerpt('text', 140)} AS pii_excerpt,
    {Q.excerpt('text', 160)} AS aml_excerpt, {Q.excerpt('text', 200)} AS reg_excerpt
FROM documents""")
def excerpt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        T.excerpt(F.col("text"), K.PII_EXCERPT_CHARS).alias("pii_excerpt"),
        T.excerpt(F.col("text"), K.AML_EXCERPT_CHARS).alias("aml_excerpt"),
        T.excerpt(F.col("text"), K.REG_EXCERPT_CHARS).alias("reg_excerpt"))


# Every event carries a list in one of the text forms a stored list can take.
_LIST_SQL = """lists AS (SELECT event_id, CASE event_type
        WHEN 'view' THEN '[''view'', ''user ' || user_id || ''']'
        WHEN 'click' THEN ' ["click" , "user ' || user_id || '", ""]'
        WHEN 'purchase' THEN 'purchase, user ' || user_id || ', '
        WHEN 'signup' THEN 'signup'
        ELSE '[''user''s error'', ''x' || user_id || ''']' END AS s FROM events),
    parsed AS (SELECT event_id, CASE
        WHEN json_valid(replace(trim(s), '''', '"')) AND trim(s) LIKE '[%]'
            THEN from_json(replace(trim(s), '''', '"'), '["VARCHAR"]')
        WHEN contains(s, ',') THEN string_split(trim(s), ',')
        ELSE [trim(s)] END AS items FROM lists)"""


def _stored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    kind = F.col("event_type")
    stored = (
        F.when(kind == "view", F.concat(F.lit("['view', '"), user, F.lit("']")))
        .when(kind == "click", F.concat(F.lit(' ["click" , "'), user, F.lit('", ""]')))
        .when(kind == "purchase", F.concat(F.lit("purchase, "), user, F.lit(", ")))
        .when(kind == "signup", "signup")
        .otherwise(F.concat(F.lit("['user's error', 'x"), F.col("user_id").cast("string"),
                            F.lit("']"))))
    return views.table(spark, sf_dir, "events").select("event_id", stored.alias("stored"))


@query("WITH " + _LIST_SQL + """
SELECT event_id, array_to_string(list_filter(list_transform(items, lambda x: trim(x)),
    lambda x: x <> ''), '|') AS items FROM parsed""")
def parse_list_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_lists(spark, sf_dir).select(
        "event_id", F.array_join(parse_list(F.col("stored")), "|").alias("items"))


@query("WITH " + _LIST_SQL + """
SELECT event_id, array_to_string(list_filter(list_transform(items,
    lambda x: regexp_replace(trim(x), '^[''"]+|[''"]+$', '', 'g')),
    lambda x: x <> ''), '|') AS items FROM parsed""")
def parse_list_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_lists(spark, sf_dir).select(
        "event_id",
        F.array_join(parse_list(F.col("stored"), strip_quotes=True), "|").alias("items"))


@query("WITH " + _LIST_SQL.replace("WHEN contains(s, ',') THEN string_split(trim(s), ',')", "") + """
SELECT event_id, array_to_string(list_filter(list_transform(items,
    lambda x: regexp_replace(trim(x), '^[''"]+|[''"]+$', '', 'g')),
    lambda x: x <> ''), '|') AS items FROM parsed""")
def parse_list_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no list stays one item, commas included."""
    return _stored_lists(spark, sf_dir).select("event_id", F.array_join(parse_list(
        F.col("stored"), split_commas=False, strip_quotes=True), "|").alias("items"))


AS_OF = "2025-01-01"

EXTENDED_SQL = f"""SELECT * FROM (
    SELECT 'reg_total_obligations' AS metric, CAST(count(*) AS DOUBLE) AS value FROM oblig
    UNION ALL SELECT 'reg_unique_documents', count(DISTINCT source_document) FROM oblig
    UNION ALL SELECT 'reg_unique_owners', count(DISTINCT owner) FROM oblig
    UNION ALL SELECT 'reg_with_deadline', count(*) FROM oblig WHERE NOT {Q.missing('deadline')}
    UNION ALL SELECT 'reg_overdue_obligations', count(*) FROM oblig
        WHERE TRY_CAST(deadline AS DATE) < DATE '{AS_OF}'
    UNION ALL SELECT 'reg_missing_owner', count(*) FROM oblig WHERE {Q.missing('owner')})"""


@query(Q.views("oblig") + f"""
SELECT metric, upper(substring(replace(substring(metric, 5), '_', ' '), 1, 1))
    || lower(substring(replace(substring(metric, 5), '_', ' '), 2)) AS label
FROM ({EXTENDED_SQL})""")
def metric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = extended_obligation_metrics(views.obligations(spark, sf_dir, with_text=False), AS_OF)
    return metrics.select("metric", T.metric_label(F.col("metric")).alias("label"))


@query(Q.views("oblig") + """
SELECT paragraph_id, coalesce(owner, CASE WHEN source_document LIKE '%1' THEN NULL
    ELSE source_document || ', ' || risk_type END, 'Unassigned') AS owner FROM oblig""")
def owner_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.when(~F.col("source_document").endswith("1"),
                   F.array("source_document", "risk_type"))
    df = views.obligations(spark, sf_dir, with_text=False).withColumn("business_unit", units)
    return df.select("paragraph_id", owner_or_units(df, K.UNASSIGNED).alias("owner"))


@query(Q.views("golden", "questions") + f"""
SELECT question_id, {Q.intent('text')} AS intent, {Q.intent('text', strict=True)} AS strict_intent
FROM questions""")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.questions(spark, sf_dir).select(
        "question_id", intents.route(F.col("text")).alias("intent"),
        intents.route(F.col("text"), strict=True).alias("strict_intent"))


@query(Q.views("golden", "questions") + """
SELECT question_id, regexp_extract(upper(text), '\\bT[0-9]+\\b', 0) AS transaction_id
FROM questions""")
def extract_txn_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.questions(spark, sf_dir).select(
        "question_id", intents.transaction_id(F.col("text")).alias("transaction_id"))


_HAS_ID = "regexp_matches(upper(text), '\\bT[0-9]+\\b')"
_SAR = f"({Q.contains_any('q', K.SAR_TRIGGERS)} OR ({_HAS_ID} AND regexp_matches(q, '\\b(sar|str)\\b')))"
ALL_INTENTS_SQL = f"""coalesce(nullif(concat_ws('|',
    CASE WHEN {Q.contains_any('q', K.PII_TRIGGERS)} OR regexp_matches(q, '\\bic\\b')
        THEN 'PII_SEARCH' END,
    CASE WHEN {Q.contains_any('q', K.AML_TRIGGERS)} OR ({_HAS_ID} AND NOT {_SAR})
        THEN 'AML_SEARCH' END,
    CASE WHEN {Q.contains_any('q', K.REG_TRIGGERS)} OR contains(q, 'mas 610')
        OR (contains(q, 'mas') AND contains(q, '610')) THEN 'REG_SEARCH' END,
    CASE WHEN {_SAR} THEN 'SAR_DRAFT' END), ''), 'OUT_OF_SCOPE')"""


@query(Q.views("golden", "questions") + f"""
SELECT question_id, {ALL_INTENTS_SQL} AS intents
FROM (SELECT *, lower(text) AS q FROM questions)""")
def intent_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.questions(spark, sf_dir).select(
        "question_id", F.array_join(intents.all_intents(F.col("text")), "|").alias("intents"))


@query(Q.views("golden", "questions") + f"""
SELECT question_id, {Q.kind('text')} AS kind FROM questions""")
def reg_report_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.questions(spark, sf_dir).select(
        "question_id", intents.report_kind(F.col("text")).alias("kind"))


@query(Q.views("tagged", "txn", "oblig") + """
SELECT table_name, record_id, CAST(payload AS VARCHAR) AS payload FROM (
SELECT 'tagged_pii' AS table_name, message_id AS record_id, to_json({message_id: message_id,
    entities: entities, risk_flag: first_risk, masked_text: masked_text}) AS payload FROM tagged
UNION ALL SELECT 'tagged_aml', transaction_id, to_json({transaction_id: transaction_id,
    tags: tags, amount_sgd: amount_sgd, date: date}) FROM txn
UNION ALL SELECT 'tagged_reg', paragraph_id, to_json({paragraph_id: paragraph_id,
    source_document: source_document, owner: owner, deadline: deadline}) FROM oblig)""")
def export_master_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    pii = views.tagged_messages(spark, sf_dir).select(
        "message_id", _bar("pii_entities").alias("entities"), "risk_flag", "masked_text")
    aml = views.tagged_transactions(spark, sf_dir).select(
        "transaction_id", _bar("aml_tags").alias("tags"), "amount_sgd", "date")
    reg = views.obligations(spark, sf_dir, with_text=False).select(
        "paragraph_id", "source_document", "owner", "deadline")
    return master_export({"tagged_pii": (pii, "message_id"),
                          "tagged_aml": (aml, "transaction_id"),
                          "tagged_reg": (reg, "paragraph_id")})
