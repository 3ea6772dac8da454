"""The domain tables and expressions in SQL, for comparison with the Spark results."""

from __future__ import annotations

from ledgerlens import constants as K
from ledgerlens.sources.views import CHECKED_QUESTIONS, MALFORMED_QUESTIONS, PATTERN_QUESTIONS

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(col: str) -> str:
    return f"trim({col}, {BLANKS})"


def missing(col: str) -> str:
    return f"({col} IS NULL OR {strip(col)} = '')"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {quote(w)})" for w in words) + ")"


def rank(col: str) -> str:
    return (f"CASE lower({col}) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 "
            f"WHEN 'critical' THEN 3 ELSE -1 END")


def level(col: str) -> str:
    return f"CASE {col} WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' ELSE 'Low' END"


def excerpt(col: str, size: int) -> str:
    flat = strip(f"replace(coalesce({col}, ''), chr(10), ' ')")
    return (f"CASE WHEN length({flat}) > {size} "
            f"THEN rtrim(substring({flat}, 1, {size - 3}), {BLANKS}) || '...' ELSE {flat} END")


def number(col: str) -> str:
    digits = f"rtrim(CAST(CAST(round({col}, 4) AS DECIMAL(38,4)) AS VARCHAR), '0')"
    return f"CASE WHEN {digits} LIKE '%.' THEN {digits} || '0' ELSE {digits} END"


def upgraded(labels: str, current: str) -> str:
    """Upgrade rules for the labels the table detectors give (Email, Account, Phone)."""
    e, a, p = (f"contains(lower({labels}), '{w}')" for w in ("email", "account", "phone"))
    rule = (f"CASE WHEN {e} AND {a} AND {p} THEN 3 WHEN {a} THEN 2 "
            f"WHEN {e} OR {p} THEN 1 ELSE -1 END")
    final = f"greatest({rank(current)}, {rule})"
    return (f"CASE WHEN ({e} OR {a} OR {p}) AND {final} >= 0 THEN {level(final)} "
            f"ELSE {current} END")


def _masking() -> str:
    steps, previous = [], "m0"
    for number_, (label, _, pattern, replacement, _) in enumerate(K.TABLE_DETECTORS, start=1):
        steps.append(
            f"m{number_} AS (SELECT *, regexp_replace(t{number_ - 1}, {quote(pattern)}, "
            f"{quote(replacement)}, 'g') AS t{number_} FROM {previous})")
        previous = f"m{number_}"
    return ",\n".join(steps)


_LAST = len(K.TABLE_DETECTORS)
_HITS = {row[0]: f"t{i} <> t{i + 1}" for i, row in enumerate(K.TABLE_DETECTORS)}
_LABELS = ", ".join(f"CASE WHEN {hit} THEN '{label}' END" for label, hit in _HITS.items())
_COUNT = " + ".join(f"CAST({hit} AS INTEGER)" for hit in _HITS.values())

_GOLDEN = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in [*K.GOLDEN_QUESTIONS,
                                                             *PATTERN_QUESTIONS,
                                                             *MALFORMED_QUESTIONS])

_CHECKED = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in [*K.GOLDEN_QUESTIONS,
                                                              *CHECKED_QUESTIONS])


def intent(col: str, strict: bool = False) -> str:
    q = f"lower({col})"
    named = f"contains({q}, 't028')" if strict else \
        f"regexp_matches(upper({col}), '\\bT[0-9]+\\b')"
    return f"""CASE
      WHEN {contains_any(q, K.PII_INTENT_WORDS)} THEN 'PII_SEARCH'
      WHEN {contains_any(q, K.AML_INTENT_WORDS)}
        OR (contains({q}, 'transactions') AND contains({q}, 'risk')) THEN 'AML_SEARCH'
      WHEN {contains_any(q, K.REG_INTENT_PHRASES)}
        OR (contains({q}, 'mas') AND contains({q}, '610')) THEN 'REG_SEARCH'
      WHEN contains({q}, 'sar') AND {named} THEN 'SAR_DRAFT'
      ELSE 'OUT_OF_SCOPE' END"""


def kind(col: str) -> str:
    q = f"lower({col})"
    topic = f"({contains_any(q, ('mas 610', 'mas notice 610'))} AND contains({q}, 'suspicious'))"
    return f"""CASE
      WHEN {topic} AND {contains_any(q, ('how many', 'count'))}
        AND contains({q}, 'deadline') THEN 'coverage'
      WHEN {topic} AND {contains_any(q, ('show', 'list'))} AND contains({q}, 'missing')
        AND {contains_any(q, ('owner', 'deadline'))} THEN 'missing' END"""


def malformed(question_id: str) -> str:
    return f"{question_id} IN ({', '.join(quote(i) for i, _ in MALFORMED_QUESTIONS)})"


def pattern(question_id: str, text: str) -> str:
    """The text as a pattern; null, which matches nothing, if it is malformed."""
    return f"CASE WHEN NOT {malformed(question_id)} THEN {text} END"


VIEWS = {
    "tagged": f"""m0 AS (SELECT CAST(doc_id AS VARCHAR) AS message_id, source AS channel, text,
        text AS t0 FROM documents),
{_masking()},
tagged AS (SELECT message_id, channel, t{_LAST} AS masked_text, concat_ws('|', {_LABELS}) AS entities,
    CASE WHEN ({_HITS['SECRET']} AND {_HITS['ACCOUNT']}) OR ({_COUNT}) >= 3 THEN 'Critical'
         WHEN {_HITS['SECRET']} OR {_HITS['ACCOUNT']} THEN 'High'
         WHEN {_HITS['EMAIL']} OR {_HITS['PHONE']} OR {_HITS['IP']} THEN 'Medium'
         ELSE 'Low' END AS first_risk,
    text AS original_text FROM m{_LAST}),
tagged_up AS (SELECT *, {upgraded('entities', 'first_risk')} AS risk_flag FROM tagged)""",
    "txn": """txn AS (SELECT 'T' || event_id AS transaction_id, value AS amount_sgd,
        strftime(ts, '%Y-%m-%d') AS date, event_type || ' ' || props AS narrative,
        event_type, least(10.0, value / 10) AS risk_score,
        concat_ws('|', event_type, CASE WHEN value > 80 THEN 'high_value' END,
            CASE WHEN event_type = 'error' AND value > 50 THEN 'crypto' END,
            CASE WHEN event_type = 'purchase' AND value >= 9 AND value < 10
                 THEN 'structuring' END) AS tags
        FROM events)""",
    "oblig": """oblig AS (SELECT CAST(d.doc_id AS VARCHAR) AS paragraph_id,
        d.source AS source_document, d.source AS regulation, d.lang AS risk_type,
        CASE l.quality WHEN 1 THEN 'Compliance' WHEN 0 THEN 'Operations' END AS owner,
        CASE l.toxic WHEN 1 THEN 'Annual' WHEN 0 THEN '' END AS deadline,
        d.text AS original_text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "topic": """topic AS (SELECT * FROM oblig
        WHERE contains(lower(source_document), 'src1') AND contains(lower(risk_type), 'en'))""",
    "golden": f"golden AS (SELECT * FROM (VALUES {_GOLDEN}) AS g(question_id, text))",
    "questions": """questions AS (SELECT question_id, text FROM golden
        UNION ALL SELECT 'u-' || conv_id || '-' || turn, text FROM conversations
            WHERE role = 'user'
        UNION ALL SELECT 'e-' || event_id, 'Draft a SAR for transaction t' || event_id
            FROM events WHERE event_type = 'error')""",
    "passage_questions": """questions AS (SELECT 'mb-' || item_id AS question_id,
            'pii|' || text AS text FROM benchmark
        UNION ALL SELECT 'rb-' || item_id, 'suspicious transactions|' || text FROM benchmark)""",
    "checked_questions": f"questions AS (SELECT * FROM (VALUES {_CHECKED}) AS c(question_id, text))",
    "routed": f"""routed AS (SELECT *, {intent('text')} AS intent, {kind('text')} AS kind,
        lower({strip('text')}) AS q FROM questions)""",
    "passages": "passages AS (SELECT 'b-' || item_id AS question_id, text FROM benchmark)",
    "centroids": """parts AS (SELECT label, unnest(embedding) AS x,
            unnest(range(len(embedding))) AS pos FROM embeddings),
        means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY label, pos),
        centroids AS (SELECT label AS query_id, list(x ORDER BY pos) AS center
            FROM means GROUP BY label)""",
    "distances": """distances AS (SELECT query_id, vec_id AS id, e.label AS label,
            pow(list_distance(CAST(embedding AS DOUBLE[]), center), 2) AS distance
            FROM embeddings e, centroids)""",
}


def views(*names: str) -> str:
    """WITH clause holding the named views."""
    return "WITH " + ",\n".join(VIEWS[n] for n in names)
