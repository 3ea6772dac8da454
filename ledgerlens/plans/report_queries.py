"""Report, answer and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens import constants as K
from ledgerlens.operators import answers as A, reports as R
from ledgerlens.operators.metrics import extended_obligation_metrics
from ledgerlens.plans import sql_views as Q
from ledgerlens.plans.registry import query
from ledgerlens.plans.search_queries import HITS_SQL
from ledgerlens.plans.tagging_queries import AS_OF, EXTENDED_SQL
from ledgerlens.sources import views

NEWLINE = "chr(10)"


def _with_excerpt(head: str, label: str, text: str) -> str:
    return (f"CASE WHEN {text} = '' THEN {head} ELSE {head} || {NEWLINE} || "
            f"{Q.quote(label)} || {text} END")


def _pii_line(masked: str, labels: str) -> str:
    head = (f"{NEWLINE} || '• ID: `' || id || '` | Risk: **' || risk_flag || '** | Entities: ' || "
            f"coalesce(nullif({labels}, ''), '(not provided)')")
    return _with_excerpt(head, K.PII_EXCERPT, f"({Q.excerpt(masked, K.PII_EXCERPT_CHARS)})")


def _aml_line(score: str, tags: str) -> str:
    risk = f"CASE WHEN {score} IS NULL THEN '(not provided)' ELSE ({Q.number(score)}) || '/10' END"
    head = (f"{NEWLINE} || '• **' || id || '** | SGD ' || ({Q.number('amount_sgd')}) || "
            f"' | Risk: **' || ({risk}) || '**' || {NEWLINE} || '  Tags: ' || "
            f"{tags}")
    return _with_excerpt(head, K.AML_NARRATIVE, f"({Q.excerpt('narrative', K.AML_EXCERPT_CHARS)})")


def _reg_line(regulation: str, owner: str) -> str:
    return (f"{NEWLINE} || '• [' || {Q.strip(regulation)} || '] ' || "
            f"({Q.excerpt('original_text', K.REG_EXCERPT_CHARS)}) || {NEWLINE} || "
            f"'  Owner: **' || {owner} || '**'")


def _quoted(template: str, *values: str) -> str:
    """SQL that fills the %d places of a fixed text."""
    parts = template.split("%d")
    sql = Q.quote(parts[0])
    for value, part in zip(values, parts[1:]):
        sql += f" || ({value}) || {Q.quote(part)}"
    return sql.replace("\n", "' || chr(10) || '")


# Answer lines of both modes: layer_* from the tagged hits, raw_* from the raw ones.
LINES_SQL = HITS_SQL + f""",
layer_pii AS (SELECT h.question_id, h.id, h.risk_flag, t.entities, t.masked_text
    FROM layer_hits h JOIN tagged_up t ON h.id = t.message_id WHERE h.intent = 'PII_SEARCH'),
layer_aml AS (SELECT h.question_id, h.id, t.*, row_number() OVER (PARTITION BY h.question_id
        ORDER BY t.risk_score DESC NULLS LAST, t.amount_sgd DESC, h.id) AS n
    FROM layer_hits h JOIN txn t ON h.id = t.transaction_id WHERE h.intent = 'AML_SEARCH'),
layer_reg AS (SELECT h.question_id, h.id, o.*, row_number() OVER (PARTITION BY h.question_id
        ORDER BY h.id) AS n
    FROM layer_hits h JOIN oblig o ON h.id = o.paragraph_id WHERE h.intent = 'REG_SEARCH'),
raw_pii AS (SELECT r.question_id, r.id, r.intent, q.text AS asked, d.text AS original_text,
        concat_ws('|', {', '.join(f"CASE WHEN contains(lower(d.text), '{w}') THEN '{l}' END"
                                  for w, l in K.RAW_ENTITY_KEYWORDS)}) AS labels,
        CASE WHEN {Q.contains_any('lower(d.text)', K.RAW_HIGH_WORDS)} THEN 'High'
             WHEN contains(lower(d.text), 'salary') THEN 'Medium' ELSE 'Low' END AS risk_flag
    FROM raw_first r JOIN routed q ON r.question_id = q.question_id
    JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id
    WHERE r.intent IN ('PII_SEARCH', 'REG_SEARCH')),
raw_aml AS (SELECT r.question_id, r.id, r.n, q.text AS asked, q.q, t.*
    FROM raw_first r JOIN routed q ON r.question_id = q.question_id
    JOIN txn t ON t.transaction_id = r.id WHERE r.intent = 'AML_SEARCH'),
hit_lines AS (
    SELECT question_id, 'layer' AS mode, 'PII_SEARCH' AS intent, id AS ord, risk_flag,
        {_pii_line('masked_text', "replace(entities, '|', ', ')")} AS line FROM layer_pii
    UNION ALL SELECT question_id, 'layer', 'AML_SEARCH', lpad(CAST(n AS VARCHAR), 2, '0'), NULL,
        {_aml_line('risk_score', "replace(tags, '|', ', ')")} FROM layer_aml WHERE n <= 20
    UNION ALL SELECT question_id, 'layer', 'REG_SEARCH', lpad(CAST(n AS VARCHAR), 2, '0'), NULL,
        {_reg_line('regulation', f"coalesce(nullif({Q.strip('owner')}, ''), '(not provided)')")}
        FROM layer_reg WHERE n <= 20
    UNION ALL SELECT question_id, 'no_layer', 'PII_SEARCH', id, risk_flag,
        {_pii_line('original_text', f"coalesce(nullif(replace(labels, '|', ', '), ''), {Q.strip('asked')})")} FROM raw_pii
        WHERE intent = 'PII_SEARCH'
    UNION ALL SELECT question_id, 'no_layer', 'AML_SEARCH', lpad(CAST(n AS VARCHAR), 2, '0'),
        NULL, {_aml_line('NULL::DOUBLE', '''coalesce(nullif(concat_ws(', ',
            CASE WHEN contains(q, 'crypto') OR contains(lower(narrative), 'crypto')
                THEN 'Crypto' END,
            CASE WHEN contains(q, 'structuring') OR contains(q, 'structured')
                OR contains(lower(narrative), 'structuring') THEN 'Structuring' END), ''),
            asked)''')} FROM raw_aml
    UNION ALL SELECT question_id, 'no_layer', 'REG_SEARCH', lpad(CAST(row_number() OVER (
        PARTITION BY question_id ORDER BY id) AS VARCHAR), 2, '0'), NULL,
        {_reg_line('original_text', "'(not tagged)'")} FROM raw_pii WHERE intent = 'REG_SEARCH'),
totals AS (SELECT question_id, mode, intent, count(*) AS n,
        count(*) FILTER (WHERE risk_flag = 'Critical') AS critical,
        count(*) FILTER (WHERE risk_flag = 'High') AS high,
        count(*) FILTER (WHERE risk_flag = 'Medium') AS medium,
        count(*) FILTER (WHERE risk_flag = 'Low') AS low
    FROM (SELECT question_id, 'layer' AS mode, intent, risk_flag FROM layer_hits
        UNION ALL SELECT r.question_id, 'no_layer', r.intent, p.risk_flag FROM raw_first r
            LEFT JOIN raw_pii p ON p.question_id = r.question_id AND p.id = r.id)
    GROUP BY ALL),
searching AS (SELECT question_id, intent, mode FROM routed, (VALUES ('layer'), ('no_layer')) m(mode)
    WHERE intent IN ('PII_SEARCH', 'AML_SEARCH', 'REG_SEARCH')
        AND (mode = 'no_layer' OR intent <> 'REG_SEARCH' OR kind IS NULL)),
shown AS (SELECT s.*, coalesce(n, 0) AS n, critical, high, medium, low FROM searching s
    LEFT JOIN totals t ON s.question_id = t.question_id AND s.mode = t.mode),
search_lines AS (
    SELECT question_id, mode, intent, 0 AS section, '' AS ord,
        CASE WHEN mode = 'no_layer' AND {Q.malformed('question_id')}
        THEN {Q.quote(K.MALFORMED_TEXT)} WHEN n = 0
        THEN {Q.quote(K.NO_RESULTS)} ELSE CASE intent WHEN 'PII_SEARCH'
        THEN {Q.quote(K.PII_HEADLINE)} WHEN 'AML_SEARCH' THEN {Q.quote(K.AML_HEADLINE)}
        ELSE {Q.quote(K.REG_HEADLINE)} END END AS line FROM shown
    UNION ALL SELECT question_id, mode, intent, 1, '', CASE intent
        WHEN 'PII_SEARCH' THEN {_quoted(K.PII_TOTAL, 'n', 'critical', 'high', 'medium', 'low')}
        WHEN 'AML_SEARCH' THEN {_quoted(K.AML_TOTAL, 'n', 'least(n, 20)')}
        ELSE {_quoted(K.REG_TOTAL, 'n', 'least(n, 20)')} END FROM shown WHERE n > 0
    UNION ALL SELECT question_id, mode, intent, 2, ord, line FROM hit_lines)"""

TOPIC_SQL = f"""
coverage_examples AS (SELECT string_agg('- ' || paragraph_id || ': ' || regulation, {NEWLINE}
    ORDER BY paragraph_id) AS examples, string_agg(paragraph_id, ',' ORDER BY paragraph_id) AS ids
    FROM (SELECT * FROM topic ORDER BY paragraph_id LIMIT 3)),
coverage_answer AS (SELECT count(*) AS total, CASE WHEN count(*) = 0 THEN {Q.quote(K.TOPIC_NONE)}
    ELSE {_quoted(K.COVERAGE_TOTAL, 'count(*)',
                  f"count(*) FILTER (WHERE NOT {Q.missing('deadline')})",
                  f"count(*) FILTER (WHERE {Q.missing('deadline')})")}
    || {_quoted(K.COVERAGE_EXAMPLES)} || (SELECT examples FROM coverage_examples) END AS line
    FROM topic),
missing_examples AS (SELECT string_agg('- ' || paragraph_id || ': ' || regulation ||
    ' … | owner=' || CASE WHEN {Q.missing('owner')} THEN '(missing)' ELSE owner END ||
    ', deadline=' || CASE WHEN {Q.missing('deadline')} THEN '(missing)' ELSE deadline END,
    {NEWLINE} ORDER BY paragraph_id) AS examples
    FROM (SELECT * FROM topic WHERE {Q.missing('owner')} OR {Q.missing('deadline')}
        ORDER BY paragraph_id LIMIT 5)),
missing_answer AS (SELECT count(*) AS total, CASE WHEN count(*) = 0 THEN {Q.quote(K.TOPIC_NONE)}
    ELSE {_quoted(K.MISSING_TOTAL, 'count(*)',
                  f"count(*) FILTER (WHERE {Q.missing('owner')} OR {Q.missing('deadline')})")}
    || coalesce({_quoted(K.MISSING_EXAMPLES)} || (SELECT examples FROM missing_examples), '')
    END AS line FROM topic),
structured AS (SELECT question_id, total, line FROM routed, coverage_answer
        WHERE intent = 'REG_SEARCH' AND kind = 'coverage'
    UNION ALL SELECT question_id, total, line FROM routed, missing_answer
        WHERE intent = 'REG_SEARCH' AND kind = 'missing')"""

DRAFT_SQL = f"""
requests AS (SELECT question_id, coalesce(nullif(regexp_extract(upper(text),
    '\\bT[0-9]+\\b', 0), ''), 'T028') AS id FROM routed WHERE intent = 'SAR_DRAFT'),
drafts AS (SELECT r.question_id, r.id AS transaction_id, CASE WHEN t.transaction_id IS NULL
    THEN {Q.quote(K.NO_SAR)} ELSE 'Amount: SGD ' || ({Q.number('amount_sgd')}) || {NEWLINE} ||
    'Typology: ' || replace(tags, '|', ', ') || {NEWLINE} || 'Risk: ' ||
    ({Q.number('risk_score')}) || '/10' || {NEWLINE} || 'Narrative: ' || narrative END
    AS sar_draft FROM requests r LEFT JOIN txn t ON t.transaction_id = r.id)"""

ANSWERS_SQL = LINES_SQL + "," + TOPIC_SQL + "," + DRAFT_SQL + f""",
answers AS (SELECT question_id, mode, section, ord, line FROM search_lines
    UNION ALL SELECT question_id, mode, 0, '', {Q.quote(K.OUT_OF_SCOPE_TEXT)}
        FROM routed, (VALUES ('layer'), ('no_layer')) m(mode) WHERE intent = 'OUT_OF_SCOPE'
    UNION ALL SELECT question_id, 'layer', 0, '', line FROM structured
    UNION ALL SELECT question_id, mode, 0, '', '**SAR Drafted for ' || transaction_id || '**'
        FROM drafts, (VALUES ('layer'), ('no_layer')) m(mode)
    UNION ALL SELECT question_id, 'layer', 1, '', sar_draft FROM drafts
    UNION ALL SELECT question_id, 'no_layer', 1, '', {Q.quote(K.NO_SAR_RAW)} FROM drafts),
tools AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{m}', '{t}')"
                                           for (i, m), t in K.TOOL_NAMES.items())})
    t(intent, mode, tool_name)),
previews AS (
    SELECT question_id, mode, string_agg(id, ',' ORDER BY n) AS preview FROM (
        SELECT question_id, 'layer' AS mode, id, row_number() OVER (PARTITION BY question_id
            ORDER BY score DESC NULLS LAST, amount DESC NULLS LAST, id) AS n FROM layer_hits
        UNION ALL SELECT question_id, 'no_layer', id, n FROM raw_first) WHERE n <= 3
    GROUP BY ALL),
trace AS (
    SELECT s.question_id, s.mode, s.intent, tool_name, n AS hit_count,
        coalesce(preview, '') AS preview FROM shown s
        JOIN tools t ON s.intent = t.intent AND s.mode = t.mode
        LEFT JOIN previews p ON s.question_id = p.question_id AND s.mode = p.mode
    UNION ALL SELECT question_id, mode, 'OUT_OF_SCOPE', NULL, 0, ''
        FROM routed, (VALUES ('layer'), ('no_layer')) m(mode) WHERE intent = 'OUT_OF_SCOPE'
    UNION ALL SELECT question_id, 'layer', 'REG_SEARCH', 'query_regulations', total,
        (SELECT coalesce(ids, '') FROM coverage_examples) FROM structured
    UNION ALL SELECT question_id, m.mode, 'SAR_DRAFT', tool_name, 1, transaction_id
        FROM drafts, (VALUES ('layer'), ('no_layer')) m(mode)
        JOIN tools t ON t.intent = 'SAR_DRAFT' AND t.mode = m.mode)"""


@query(LINES_SQL + """
SELECT question_id, section, ord, line FROM search_lines
WHERE mode = 'layer' AND intent = 'PII_SEARCH'""")
def report_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, K.PII_SEARCH)


@query(LINES_SQL + """
SELECT question_id, section, ord, line FROM search_lines
WHERE mode = 'layer' AND intent = 'AML_SEARCH'""")
def report_aml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, K.AML_SEARCH)


@query(LINES_SQL + """
SELECT question_id, section, ord, line FROM search_lines
WHERE mode = 'layer' AND intent = 'REG_SEARCH'""")
def report_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, K.REG_SEARCH)


def _report(spark: SparkSession, sf_dir: str, intent: str) -> DataFrame:
    results = A.search_all(views.questions(spark, sf_dir), views.corpus(spark, sf_dir, [intent]),
                           K.MODE_TAGGED, intents=[intent])
    found = results.found[intent]
    return found.spread(A.report(intent, found))


@query(Q.views("oblig") + f""",
numbers AS ({EXTENDED_SQL})
SELECT 0 AS section, '' AS ord, {Q.quote(K.SNAPSHOT_HEADLINE)} AS line
UNION ALL SELECT CAST(list_position([{', '.join(Q.quote(n) for n in K.SNAPSHOT_ORDER)}], metric)
    AS INTEGER), metric, '- ' || upper(substring(replace(substring(metric, 5), '_', ' '), 1, 1)) ||
    lower(substring(replace(substring(metric, 5), '_', ' '), 2)) || ': ' || CAST(value AS BIGINT)
FROM numbers WHERE value <> 0""")
def report_reg_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = extended_obligation_metrics(views.obligations(spark, sf_dir, with_text=False), AS_OF)
    return R.snapshot_report(metrics)


@query(Q.views("oblig", "topic", "golden", "questions", "routed") + "," + TOPIC_SQL + """
SELECT 'coverage' AS kind, total AS hit_count, line FROM coverage_answer""")
def report_deadline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage_answer(views.TABLE_TOPIC.rows(
        views.obligations(spark, sf_dir, with_text=False)))


@query(Q.views("oblig", "topic", "golden", "questions", "routed") + "," + TOPIC_SQL + """
SELECT 'missing' AS kind, total AS hit_count, line FROM missing_answer""")
def report_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_answer(views.TABLE_TOPIC.rows(
        views.obligations(spark, sf_dir, with_text=False)))


@query(Q.views("txn", "golden", "questions", "routed") + "," + DRAFT_SQL + """
SELECT question_id, transaction_id, sar_draft FROM drafts""")
def sar_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = A.routed(views.questions(spark, sf_dir), K.MODE_TAGGED)
    requests = R.draft_requests(routed.where(F.col("intent") == K.SAR_DRAFT))
    return R.sar_drafts(requests, views.tagged_transactions(spark, sf_dir))


@query(ANSWERS_SQL + "SELECT * FROM answers")
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, corpus = views.questions(spark, sf_dir), views.corpus(spark, sf_dir)
    raw, tagged = A.search_both(asked, corpus)
    return A.answer_lines(raw).unionByName(A.answer_lines(tagged))


@query(ANSWERS_SQL.replace(Q.VIEWS["questions"], Q.VIEWS["passage_questions"]) + """
SELECT * FROM answers WHERE mode = 'no_layer'""")
def answer_passage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers to two searches for each benchmark passage, all of them distinct patterns."""
    asked, corpus = views.passage_questions(spark, sf_dir), views.corpus(spark, sf_dir, [])
    return A.answer_lines(A.search_all(asked, corpus, K.MODE_RAW))


@query(ANSWERS_SQL + """
SELECT question_id, mode, intent, tool_name, hit_count, hit_count = 0 AS no_results, preview
FROM trace""")
def answer_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, corpus = views.questions(spark, sf_dir), views.corpus(spark, sf_dir)
    raw, tagged = A.search_both(asked, corpus)
    trace = A.answer_trace(raw).unionByName(A.answer_trace(tagged))
    return trace.withColumn("preview", F.array_join("preview.id", ","))


@query(ANSWERS_SQL + """,
lengths AS (SELECT question_id, mode, CAST(sum(length(line)) + count(*) - 1 AS BIGINT)
    AS answer_length FROM answers GROUP BY ALL),
sides AS (SELECT t.*, answer_length FROM trace t JOIN lengths l
    ON t.question_id = l.question_id AND t.mode = l.mode)
SELECT r.question_id, r.intent AS raw_intent, r.tool_name AS raw_tool, r.hit_count AS raw_hits,
    r.hit_count = 0 AS raw_no_results, r.answer_length AS raw_answer_length,
    t.intent AS tagged_intent, t.tool_name AS tagged_tool, t.hit_count AS tagged_hits,
    t.hit_count = 0 AS tagged_no_results, t.answer_length AS tagged_answer_length
FROM (SELECT * FROM sides WHERE mode = 'no_layer') r
FULL JOIN (SELECT * FROM sides WHERE mode = 'layer') t ON r.question_id = t.question_id""")
def compare_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compare_modes(views.questions(spark, sf_dir), views.corpus(spark, sf_dir))


# Questions with one key have one answer, named after the first of them.
_MEMBERS = f"""
asked_keys AS (SELECT question_id, mode, CASE
    WHEN intent = 'OUT_OF_SCOPE' THEN 'out'
    WHEN intent = 'SAR_DRAFT' OR (mode = 'layer' AND intent = 'REG_SEARCH' AND kind IS NOT NULL)
        THEN 'own ' || question_id
    WHEN mode = 'no_layer' AND {Q.malformed('question_id')} THEN 'malformed'
    WHEN mode = 'no_layer' THEN intent || ' ' || text
    WHEN intent = 'PII_SEARCH' AND contains(q, 'nric') THEN 'entity nric'
    WHEN intent = 'PII_SEARCH' AND {Q.contains_any('q', ('salary', 'income', 'pay'))}
        THEN 'entity salary'
    WHEN intent = 'PII_SEARCH' AND contains(q, 'phone') THEN 'entity phone'
    WHEN intent = 'AML_SEARCH' AND contains(q, 'crypto') THEN 'hint crypto'
    WHEN intent = 'AML_SEARCH' AND contains(q, 'structuring') THEN 'hint structuring'
    ELSE intent || ' ' || q END AS key
    FROM routed, (VALUES ('layer'), ('no_layer')) m(mode)),
members AS (SELECT question_id, mode, min(question_id) OVER (PARTITION BY mode, key) AS answer_id
    FROM asked_keys)"""


@query(Q.views("golden", "questions", "routed") + "," + _MEMBERS + """
SELECT question_id, mode, answer_id FROM members""")
def answer_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored answer each question has."""
    both = A.search_both(views.questions(spark, sf_dir), views.corpus(spark, sf_dir))
    raw, tagged = (A.answer_tables(results)[1] for results in both)
    return raw.unionByName(tagged)


@query(ANSWERS_SQL + "," + _MEMBERS + """
SELECT a.question_id AS answer_id, a.mode, section, ord, line FROM answers a
JOIN members m ON a.question_id = m.answer_id AND m.question_id = m.answer_id AND a.mode = m.mode""")
def answer_lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored answers; no line stands there once for each question."""
    both = A.search_both(views.questions(spark, sf_dir), views.corpus(spark, sf_dir))
    raw, tagged = (A.answer_tables(results)[0] for results in both)
    return raw.unionByName(tagged)
