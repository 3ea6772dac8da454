"""Search, ranking, fan-out and validation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens import constants as K
from ledgerlens.operators import answers as A, reports as R, search as S, validation as V
from ledgerlens.operators.phrase_join import phrase_join
from ledgerlens.plans import sql_views as Q
from ledgerlens.plans.registry import query
from ledgerlens.plans.tagging_queries import ALL_INTENTS_SQL
from ledgerlens.sources import views
from ledgerlens.sources.storage import materialise

RAW_MESSAGE_PATTERN = "token = |secret = "
RAW_TRANSACTION_PATTERN = "purchase.*7"
RAW_PARAGRAPH_PATTERN = "licensed under"


def _bar(column: str):
    return F.array_join(column, "|")


# --- raw search, one question ----------------------------------------------

@query(f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, source AS channel, text FROM documents
WHERE regexp_matches(text, '{RAW_MESSAGE_PATTERN}', 'i')
ORDER BY CAST(doc_id AS VARCHAR) LIMIT 20""")
def raw_search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_raw_messages(views.messages(spark, sf_dir), RAW_MESSAGE_PATTERN)


@query(Q.views("txn") + f"""
SELECT transaction_id, amount_sgd, date, narrative FROM txn
WHERE regexp_matches(narrative, '{RAW_TRANSACTION_PATTERN}', 'i')
ORDER BY transaction_id LIMIT 20""")
def raw_search_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_raw_transactions(views.transactions(spark, sf_dir), RAW_TRANSACTION_PATTERN)


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS paragraph_id, source AS source_document,
    CAST(NULL AS VARCHAR) AS regulation, CAST(NULL AS VARCHAR) AS article, text AS paragraph_text
FROM documents WHERE contains(lower(text), '{RAW_PARAGRAPH_PATTERN}')
ORDER BY paragraph_id LIMIT 20""")
def raw_search_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_raw_paragraphs(views.paragraphs(spark, sf_dir), RAW_PARAGRAPH_PATTERN,
                                   literal=True)


# --- tagged search, one question -------------------------------------------

@query(Q.views("tagged") + """
SELECT message_id, entities AS pii_entities, risk_flag, masked_text FROM tagged_up
WHERE contains(lower(entities), 'phone')""")
def pii_search_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = views.tagged_messages_upgraded(spark, sf_dir)
    return S.search_messages(tagged, "Which phone contacts are exposed?").select(
        "message_id", _bar("pii_entities").alias("pii_entities"), "risk_flag", "masked_text")


@query(Q.views("tagged") + """
SELECT message_id, entities AS pii_entities, risk_flag FROM tagged_up
WHERE contains(lower(original_text), 'licensed under') OR
      contains(lower(masked_text), 'licensed under')""")
def pii_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = views.tagged_messages_upgraded(spark, sf_dir)
    return S.search_messages(tagged, "Licensed under").select(
        "message_id", _bar("pii_entities").alias("pii_entities"), "risk_flag")


# Ids of all transactions asked for by a report request, looked up as whole questions.
@query(Q.views("txn", "golden", "questions") + """,
asked AS (SELECT question_id, regexp_extract(upper(text), '\\bT[0-9]+\\b', 0) AS id
    FROM questions WHERE regexp_matches(upper(text), '\\bT[0-9]+\\b'))
SELECT question_id, transaction_id, amount_sgd, risk_score, tags AS aml_tags
FROM asked JOIN txn ON transaction_id = id""")
def aml_lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = R.draft_requests(views.questions(spark, sf_dir)
                           .where(F.col("text").rlike("(?i)\\bT[0-9]+\\b")))
    keys = materialise(S.transaction_keys(
        ids.select("question_id", F.lower("wanted_id").alias("text"))), "lookup-keys")
    hits = S.match_transactions(views.tagged_transactions(spark, sf_dir), keys)
    return S.per_question(keys, hits).select(
        "question_id", "transaction_id", "amount_sgd", "risk_score",
        _bar("aml_tags").alias("aml_tags"))


@query(Q.views("txn") + """
SELECT transaction_id, amount_sgd, tags AS aml_tags, risk_score FROM txn
WHERE contains(lower(narrative || ' ' || tags), 'crypto')""")
def aml_search_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.search_transactions(views.tagged_transactions(spark, sf_dir),
                                 "Find high-risk transactions related to crypto.")
    return hits.select("transaction_id", "amount_sgd", _bar("aml_tags").alias("aml_tags"),
                       "risk_score")


@query(Q.views("oblig") + """
SELECT paragraph_id, source_document, owner, deadline FROM oblig
WHERE (contains(source_document, 'src1') OR contains(lower(original_text), 'mas 610'))
  AND (contains(lower(regulation || ' ' || original_text), 'suspicious')
       OR contains(lower(regulation || ' ' || original_text), 'str'))""")
def reg_search_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.search_obligations(views.obligations(spark, sf_dir), K.GOLDEN_QUESTIONS[4][1],
                                source_token=views.TABLE_SOURCE_TOKEN)
    return hits.select("paragraph_id", "source_document", "owner", "deadline")


@query(Q.views("oblig") + """
SELECT paragraph_id, source_document, owner, deadline FROM oblig
WHERE contains(lower(regulation || ' ' || original_text), 'public license')""")
def reg_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_obligations(views.obligations(spark, sf_dir), "Public License").select(
        "paragraph_id", "source_document", "owner", "deadline")


@query(Q.views("oblig") + f"""
SELECT paragraph_id, source_document, risk_type, deadline FROM oblig
WHERE {Q.missing('deadline')}""")
def reg_filter_missing_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_obligations(views.obligations(spark, sf_dir, with_text=False),
                                missing_deadline=True) \
        .select("paragraph_id", "source_document", "risk_type", "deadline")


@query(Q.views("oblig") + f"""
SELECT paragraph_id, source_document, risk_type, owner FROM oblig WHERE {Q.missing('owner')}""")
def reg_filter_missing_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_obligations(views.obligations(spark, sf_dir, with_text=False),
                                missing_owner=True) \
        .select("paragraph_id", "source_document", "risk_type", "owner")


@query(Q.views("oblig") + f"""
SELECT paragraph_id, source_document, risk_type, owner, deadline FROM oblig
WHERE regexp_matches(source_document, 'SRC1', 'i') AND regexp_matches(risk_type, 'EN|fr', 'i')
  AND {Q.missing('deadline')}""")
def reg_filter_source_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_obligations(
        views.obligations(spark, sf_dir, with_text=False), source_document="SRC1",
        risk_type="EN|fr", missing_deadline=True,
    ).select("paragraph_id", "source_document", "risk_type", "owner", "deadline")


# --- weak enrichment of raw hits -------------------------------------------

_WEAK = ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{label}' END"
                  for w, label in K.RAW_ENTITY_KEYWORDS)


@query(Q.views("golden", "passages") + f""",
asked AS (SELECT question_id, text FROM golden UNION ALL SELECT question_id, text FROM passages),
hits AS (SELECT a.question_id, a.text AS q, CAST(d.doc_id AS VARCHAR) AS message_id,
        lower(d.text) AS t, row_number() OVER (PARTITION BY a.question_id
            ORDER BY CAST(d.doc_id AS VARCHAR)) AS n
    FROM asked a JOIN documents d ON regexp_matches(d.text, {Q.pattern('a.question_id', 'a.text')}, 'i'))
SELECT question_id, message_id, coalesce(nullif(concat_ws('|', {_WEAK}), ''), q) AS pii_entities,
    CASE WHEN {Q.contains_any('t', K.RAW_HIGH_WORDS)} THEN 'High'
         WHEN contains(t, 'salary') THEN 'Medium' ELSE 'Low' END AS risk_flag
FROM hits WHERE n <= 20""")
def pii_raw_weak_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.golden_questions(spark).unionByName(views.passages(spark, sf_dir))
    keys = S.raw_keys(asked)
    hits = S.weak_message_tags(S.match_raw(views.messages(spark, sf_dir), "message_id", "text",
                                           keys, S.RAW_MESSAGE_FIELDS))
    narrow = hits.select("search_key", "message_id", _bar("pii_entities").alias("pii_entities"),
                         "risk_flag")
    return S.per_question(keys, S.first_hits(narrow, "message_id"))


@query(Q.views("txn", "golden") + f""",
asked AS (SELECT question_id, text FROM golden UNION ALL
    SELECT DISTINCT 't-' || event_type, event_type FROM events),
hits AS (SELECT question_id, lower(text) AS q, text, transaction_id, amount_sgd,
        lower(narrative) AS n, row_number() OVER (PARTITION BY question_id
            ORDER BY transaction_id) AS r
    FROM asked JOIN txn ON regexp_matches(narrative, {Q.pattern('question_id', 'text')}, 'i'))
SELECT question_id, transaction_id, amount_sgd, coalesce(nullif(concat_ws('|',
    CASE WHEN contains(q, 'crypto') OR contains(n, 'crypto') THEN 'Crypto' END,
    CASE WHEN contains(q, 'structuring') OR contains(q, 'structured')
              OR contains(n, 'structuring') THEN 'Structuring' END), ''), text) AS aml_tags
FROM hits WHERE r <= 20""")
def aml_raw_weak_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    transactions = views.transactions(spark, sf_dir)
    types = views.table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.concat(F.lit("t-"), "event_type").alias("question_id"),
        F.col("event_type").alias("text"))
    keys = S.raw_keys(views.golden_questions(spark).unionByName(types))
    hits = S.weak_transaction_tags(S.match_raw(
        transactions, "transaction_id", "narrative", keys, S.RAW_TRANSACTION_FIELDS))
    narrow = hits.select("search_key", "transaction_id", "amount_sgd",
                         _bar("aml_tags").alias("aml_tags"))
    return S.per_question(keys, S.first_hits(narrow, "transaction_id"))


@query(Q.views("golden", "passages") + f""",
asked AS (SELECT question_id, text FROM golden UNION ALL SELECT question_id, text FROM passages),
hits AS (SELECT a.question_id, CAST(d.doc_id AS VARCHAR) AS paragraph_id, source, d.text,
        row_number() OVER (PARTITION BY a.question_id ORDER BY CAST(d.doc_id AS VARCHAR)) AS n
    FROM asked a JOIN documents d ON regexp_matches(d.text, {Q.pattern('a.question_id', 'a.text')}, 'i'))
SELECT question_id, paragraph_id, source AS source_document, md5(text) AS regulation,
    '(not tagged)' AS owner, CAST(NULL AS VARCHAR) AS deadline FROM hits WHERE n <= 20""")
def reg_raw_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = S.raw_keys(views.golden_questions(spark).unionByName(views.passages(spark, sf_dir)))
    hits = S.raw_obligation_shape(S.match_raw(
        views.paragraphs(spark, sf_dir), "paragraph_id", "paragraph_text", keys,
        S.RAW_PARAGRAPH_FIELDS))
    narrow = hits.select("search_key", "paragraph_id", "source_document",
                         F.md5("regulation").alias("regulation"), "owner", "deadline")
    return S.per_question(keys, S.first_hits(narrow, "paragraph_id"))


# --- batch search ----------------------------------------------------------

MESSAGE_MATCH = f"""CASE WHEN contains(q, 'nric') THEN contains('|' || lower(entities) || '|', '|nric|')
    WHEN {Q.contains_any('q', ('salary', 'income', 'pay'))}
        THEN {Q.contains_any('lower(entities)', ('salary', 'income'))}
    WHEN contains(q, 'phone') THEN contains(lower(entities), 'phone')
    ELSE contains(lower(original_text), q) OR contains(lower(masked_text), q) END"""


@query(Q.views("tagged", "golden", "passages") + f""",
asked AS (SELECT question_id, lower({Q.strip('text')}) AS q FROM
    (SELECT question_id, text FROM golden UNION ALL SELECT question_id, text FROM passages))
SELECT question_id, message_id, risk_flag FROM asked JOIN tagged_up ON {MESSAGE_MATCH}""")
def batch_search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.golden_questions(spark).unionByName(views.passages(spark, sf_dir))
    keys = S.message_keys(asked)
    corpus = views.corpus(spark, sf_dir, [K.PII_SEARCH])
    hits = S.match_messages(corpus.tagged_messages, keys)
    return S.per_question(keys, hits).select("question_id", "message_id", "risk_flag")


@query(Q.views("passages") + """
SELECT question_id, CAST(doc_id AS VARCHAR) AS message_id
FROM passages p JOIN documents d ON contains(lower(d.text), lower(p.text))""")
def passage_hits_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages quote which passages, when the passages are too many to be broadcast:
    ids and pieces are shuffled."""
    passages = views.passages(spark, sf_dir)
    hits = phrase_join(views.messages(spark, sf_dir).select("message_id", "text"), "message_id",
                       "text", passages, "text", literal_phrases=0, broadcast_bytes=1)
    return hits.select("message_id", "phrase").join(
        passages.withColumnRenamed("text", "phrase"), "phrase").select("question_id", "message_id")


HITS_SQL = Q.views("tagged", "txn", "oblig", "topic", "golden", "questions", "routed") + f""",
raw_hits AS (
    SELECT question_id, intent, CAST(doc_id AS VARCHAR) AS id,
        CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS amount
    FROM routed r JOIN documents d ON regexp_matches(d.text, {Q.pattern('r.question_id', 'r.text')}, 'i')
    WHERE intent IN ('PII_SEARCH', 'REG_SEARCH')
    UNION ALL
    SELECT question_id, intent, transaction_id, NULL, NULL FROM routed r
        JOIN txn ON regexp_matches(narrative, {Q.pattern('r.question_id', 'r.text')}, 'i') WHERE intent = 'AML_SEARCH'),
raw_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id)
    AS n FROM raw_hits) WHERE n <= 20),
layer_hits AS (
    SELECT question_id, intent, message_id AS id, CAST(NULL AS DOUBLE) AS score,
        CAST(NULL AS DOUBLE) AS amount, risk_flag
    FROM (SELECT * FROM routed WHERE intent = 'PII_SEARCH') JOIN tagged_up ON {MESSAGE_MATCH}
    UNION ALL
    SELECT question_id, intent, transaction_id, risk_score, amount_sgd, NULL
    FROM (SELECT * FROM routed WHERE intent = 'AML_SEARCH')
    JOIN txn ON contains(lower(narrative || ' ' || narrative || '|' || tags),
        CASE WHEN contains(q, 'crypto') THEN 'crypto'
             WHEN contains(q, 'structuring') THEN 'structuring' ELSE q END)
    UNION ALL
    SELECT question_id, intent, paragraph_id, NULL, NULL, NULL
    FROM (SELECT * FROM routed WHERE intent = 'REG_SEARCH' AND kind IS NULL)
    JOIN oblig ON contains(lower(regulation || ' ' || original_text), q)
        OR (contains(q, 'mas') AND contains(q, '610')
            AND (contains(q, 'suspicious') OR contains(q, 'str'))
            AND (contains(source_document, 'src1')
                 OR contains(lower(original_text), 'mas 610'))
            AND (contains(lower(original_text), 'suspicious')
                 OR contains(lower(regulation || ' ' || original_text), 'str'))))"""


@query(HITS_SQL + """,
searching AS (SELECT question_id, intent, kind FROM routed
    WHERE intent IN ('PII_SEARCH', 'AML_SEARCH', 'REG_SEARCH'))
SELECT s.question_id, 'no_layer' AS mode, s.intent, count(h.id) AS hit_count
FROM searching s LEFT JOIN raw_first h ON s.question_id = h.question_id GROUP BY ALL
UNION ALL
SELECT s.question_id, 'layer', s.intent, count(h.id)
FROM (SELECT * FROM searching WHERE intent <> 'REG_SEARCH' OR kind IS NULL) s
LEFT JOIN layer_hits h ON s.question_id = h.question_id GROUP BY ALL""")
def search_counts_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, corpus = views.questions(spark, sf_dir), views.corpus(spark, sf_dir)
    raw, tagged = A.search_both(asked, corpus)
    return A.search_counts(raw).unionByName(A.search_counts(tagged))


@query(HITS_SQL + """
SELECT question_id, id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id
    ORDER BY score DESC NULLS LAST, amount DESC NULLS LAST, id) AS n FROM layer_hits)
WHERE n <= 3""")
def preview_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = A.search_all(views.questions(spark, sf_dir), views.corpus(spark, sf_dir),
                           K.MODE_TAGGED)
    parts = []
    for found in results.found.values():
        top = S.top_per_question(found.keys, found.hits, found.order, K.PREVIEW_ROWS)
        parts.append(found.spread(
            top.select("question_id", F.col(found.record_id).alias("id"), "rank")))
    return reduce(DataFrame.unionByName, parts)


# --- rankings --------------------------------------------------------------

@query(Q.views("txn") + """
SELECT transaction_id, risk_score, amount_sgd FROM txn""")
def aml_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions, highest score first."""
    return R.ranked_transactions(views.tagged_transactions(spark, sf_dir)) \
        .select("transaction_id", "risk_score", "amount_sgd")


@query(Q.views("tagged") + f"""
SELECT message_id, risk_flag FROM tagged_up
ORDER BY {Q.rank('risk_flag')} DESC, message_id LIMIT 10""")
def pii_top10_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_messages_by_risk(views.tagged_messages_upgraded(spark, sf_dir)) \
        .select("message_id", "risk_flag")


@query(Q.views("txn") + """
SELECT transaction_id, risk_score, amount_sgd FROM txn
ORDER BY risk_score DESC NULLS LAST, amount_sgd DESC, transaction_id LIMIT 10""")
def aml_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_transactions(views.tagged_transactions(spark, sf_dir)) \
        .select("transaction_id", "risk_score", "amount_sgd")


# --- several domains at once -----------------------------------------------

@query(Q.views("tagged", "txn", "oblig", "golden", "questions") + f""",
spread AS (SELECT question_id, q, unnest(string_split({ALL_INTENTS_SQL}, '|')) AS intent
    FROM (SELECT *, lower(text) AS q FROM questions)),
hits AS (
    SELECT question_id, intent, message_id AS id
    FROM (SELECT * FROM spread WHERE intent = 'PII_SEARCH') JOIN tagged_up ON {MESSAGE_MATCH}
    UNION ALL SELECT question_id, intent, transaction_id
    FROM (SELECT * FROM spread WHERE intent = 'AML_SEARCH')
    JOIN txn ON contains(lower(narrative || ' ' || narrative || '|' || tags),
        CASE WHEN contains(q, 'crypto') THEN 'crypto'
             WHEN contains(q, 'structuring') THEN 'structuring' ELSE q END)
    UNION ALL SELECT question_id, intent, paragraph_id
    FROM (SELECT * FROM spread WHERE intent = 'REG_SEARCH')
    JOIN oblig ON contains(lower(regulation || ' ' || original_text), q)
        OR (contains(q, 'mas') AND contains(q, '610')
            AND (contains(q, 'suspicious') OR contains(q, 'str'))
            AND (contains(source_document, 'src1')
                 OR contains(lower(original_text), 'mas 610'))
            AND (contains(lower(original_text), 'suspicious')
                 OR contains(lower(regulation || ' ' || original_text), 'str'))))
SELECT s.question_id, s.intent, count(h.id) AS hit_count FROM spread s
LEFT JOIN hits h ON s.question_id = h.question_id AND s.intent = h.intent GROUP BY ALL""")
def cross_domain_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fan_out(views.questions(spark, sf_dir), views.corpus(spark, sf_dir))


# --- validation ------------------------------------------------------------

def _checked(spark: SparkSession, sf_dir: str, *intents: str):
    """Reports of the domains, each with its hits."""
    results = A.search_all(views.questions(spark, sf_dir), views.corpus(spark, sf_dir, intents),
                           K.MODE_TAGGED, intents=intents)
    for intent, found in results.found.items():
        yield intent, found, A.report(intent, found), results.corpus


@query(HITS_SQL + """
SELECT question_id, 'ids' AS check, CASE intent WHEN 'AML_SEARCH' THEN least(count(*), 20)
    ELSE count(*) END AS checked, true AS ok
FROM layer_hits WHERE intent <> 'REG_SEARCH' GROUP BY question_id, intent""")
def validate_report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligation lines carry no id, so two domains are checked."""
    patterns = {K.PII_SEARCH: V.MESSAGE_ID, K.AML_SEARCH: V.TRANSACTION_ID}
    parts = [found.spread(V.check_ids(lines, S.per_question(found.keys, found.hits),
                                      found.record_id, patterns[intent]))
             for intent, found, lines, _ in _checked(spark, sf_dir, *patterns)]
    return reduce(DataFrame.unionByName, parts)


@query(HITS_SQL + """
SELECT question_id, 'counts' AS check, CAST(1 AS BIGINT) AS checked, true AS ok
FROM layer_hits GROUP BY question_id""")
def validate_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [found.spread(V.check_counts(lines, S.counts_per_question(found.keys, found.hits)))
             for _, found, lines, _ in _checked(spark, sf_dir, *A.SEARCHES)]
    return reduce(DataFrame.unionByName, parts)


@query(HITS_SQL + """
SELECT question_id, CASE intent WHEN 'AML_SEARCH' THEN 'numbers' ELSE 'masking' END AS check,
    CASE intent WHEN 'AML_SEARCH' THEN least(count(*), 20) ELSE count(*) END AS checked,
    true AS ok
FROM layer_hits WHERE intent <> 'REG_SEARCH' GROUP BY question_id, intent""")
def validate_report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for intent, found, lines, corpus in _checked(spark, sf_dir, K.PII_SEARCH, K.AML_SEARCH):
        if intent == K.PII_SEARCH:
            checked = V.check_masking(lines, corpus.tagged_messages)
        else:
            checked = V.check_numbers(lines, corpus.tagged_transactions)
        parts.append(found.spread(checked))
    return reduce(DataFrame.unionByName, parts)


def _with_faults(lines: DataFrame) -> DataFrame:
    """Report lines with faults by the last character of the question's id.

    1: another excerpt; 2: another total; 3: another id; 4: another amount.
    """
    def fault(last: str, section: int, pattern: str, by: str):
        return F.when(F.col("question_id").endswith(last) & (F.col("section") == section),
                      F.regexp_replace("line", pattern, by))

    return lines.withColumn("line", F.coalesce(
        fault("1", 2, "$", " and more"), fault("2", 1, "Total: ", "Total: 9"),
        fault("3", 2, "([`*])(T?[0-9]+[`*])", "$1X$2"), fault("4", 2, "SGD ", "SGD 1"), "line"))


@query(HITS_SQL.replace(Q.VIEWS["questions"], Q.VIEWS["checked_questions"]) + """,
counted AS (SELECT question_id, intent, count(*) AS n FROM layer_hits GROUP BY ALL),
cited AS (SELECT question_id, intent, CASE intent WHEN 'AML_SEARCH' THEN least(n, 20) ELSE n END
    AS checked FROM counted WHERE intent <> 'REG_SEARCH')
SELECT question_id, 'ids' AS check, checked, question_id NOT LIKE '%3' AS ok FROM cited
UNION ALL SELECT question_id, 'counts', 1, question_id NOT LIKE '%2' FROM counted
UNION ALL SELECT question_id, 'numbers', checked, right(question_id, 1) NOT IN ('3', '4')
    FROM cited WHERE intent = 'AML_SEARCH'
UNION ALL SELECT question_id, 'masking', checked, right(question_id, 1) NOT IN ('1', '3')
    FROM cited WHERE intent = 'PII_SEARCH'""")
def validate_faulty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of written reports, some of which were changed after they were made."""
    results = A.search_all(views.checked_questions(spark), views.corpus(spark, sf_dir),
                           K.MODE_TAGGED)
    parts = []
    for intent, found in results.found.items():
        lines = materialise(_with_faults(found.spread(A.report(intent, found))), "reports")
        hits = found.spread(S.per_question(found.keys, found.hits))
        parts.append(V.check_counts(
            lines, found.spread(S.counts_per_question(found.keys, found.hits))))
        if intent == K.PII_SEARCH:
            parts += [V.check_ids(lines, hits, found.record_id, V.MESSAGE_ID),
                      V.check_masking(lines, results.corpus.tagged_messages)]
        if intent == K.AML_SEARCH:
            parts += [V.check_ids(lines, hits, found.record_id, V.TRANSACTION_ID),
                      V.check_numbers(lines, results.corpus.tagged_transactions)]
    return reduce(DataFrame.unionByName, parts)
