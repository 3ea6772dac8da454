"""Search over raw and tagged records, for one question or a table of them.

Batch search never pairs questions with records directly.  Questions are first
reduced to distinct *search keys* (an entity, a hint, a rule, or the question
text itself); hits are found once per key, and questions get theirs by joining
on the key.  A thousand people asking for the same thing cost one search.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.intents import mentions_notice
from ledgerlens.functions.lists import compact
from ledgerlens.functions.text import contains_any, is_missing, strip
from ledgerlens.operators.phrase_join import phrase_join
from ledgerlens.sources.storage import materialise, regrouped

# Cannot occur in a question, so a phrase never matches across two fields.
FIELD_BREAK = "\x01"
TEXT_KEY = "text:"

MESSAGE_FIELDS = ("message_id", "pii_entities", "risk_flag", "original_text", "masked_text")
TRANSACTION_FIELDS = ("transaction_id", "amount_sgd", "aml_tags", "risk_score",
                      "masked_narrative", "original_narrative")
OBLIGATION_FIELDS = ("paragraph_id", "source_document", "regulation", "paragraph_text", "owner",
                     "business_unit", "assigned_to", "deadline", "original_text")
RAW_MESSAGE_FIELDS = ("message_id", "channel", "text")
RAW_TRANSACTION_FIELDS = ("transaction_id", "amount_sgd", "date", "narrative")
RAW_PARAGRAPH_FIELDS = ("paragraph_id", "source_document", "regulation", "article",
                        "paragraph_text")


def known_columns(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A user's table under the names used here.

    A wanted column that is missing is taken from the first other name that the table has.
    """
    held = {c.lower() for c in df.columns}
    found = {name: next((c for c in K.COLUMN_NAMES.get(name, ()) if c.lower() in held), None)
             for name in fields if name.lower() not in held}
    return df.withColumns({name: F.col(c) for name, c in found.items() if c is not None})


def _shape(df: DataFrame, fields: Sequence[str], *extra: str) -> DataFrame:
    """Keep the wanted fields; a field the table lacks becomes null."""
    return df.select(*extra, *[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f)
                               for f in fields])


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def ranked_first(df: DataFrame, group: str | list[str], order: Sequence[Column], n: int,
                 rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their rank.

    Spark limits each group before the shuffle, so a group holding a large part
    of all rows still moves at most ``n`` rows per task.
    """
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


# --- raw search ------------------------------------------------------------

def raw_search(records: DataFrame, text: str, query: str, record_id: str,
               fields: Sequence[str], *, literal: bool = False,
               limit: int = K.RAW_HIT_LIMIT) -> DataFrame:
    """First ``limit`` records, by id, whose text matches ``query`` ignoring case.

    The query is a regular expression, or plain text with ``literal``.
    """
    if literal:
        match = F.lower(text).contains(query.lower())
    else:
        re.compile(query)
        match = F.col(text).rlike("(?iu)" + query)
    return _shape(records.where(match), fields).orderBy(record_id).limit(limit)


def search_raw_messages(messages: DataFrame, query: str, **options) -> DataFrame:
    return raw_search(messages, "text", query, "message_id", RAW_MESSAGE_FIELDS, **options)


def search_raw_transactions(transactions: DataFrame, query: str, **options) -> DataFrame:
    return raw_search(transactions, "narrative", query, "transaction_id",
                      RAW_TRANSACTION_FIELDS, **options)


def search_raw_paragraphs(paragraphs: DataFrame, query: str, **options) -> DataFrame:
    return raw_search(paragraphs, "paragraph_text", query, "paragraph_id",
                      RAW_PARAGRAPH_FIELDS, **options)


# --- tagged search, one question ------------------------------------------

def _label_lines(labels: Column) -> Column:
    return F.concat(F.lit("\n"), F.lower(F.array_join(labels, "\n")), F.lit("\n"))


def _entity_flags(labels: Column) -> dict[str, Column]:
    lines = _label_lines(labels)
    return {
        "nric": lines.contains("\nnric\n"),
        "salary": contains_any(lines, ("salary", "income")),
        "phone": lines.contains("phone"),
    }


def _entity_key(folded: Column) -> Column:
    """The entity a question asks for; null for a plain text search."""
    return (
        F.when(folded.contains("nric"), "nric")
        .when(contains_any(folded, ("salary", "income", "pay")), "salary")
        .when(folded.contains("phone"), "phone")
    )


def _message_haystack(df: DataFrame) -> Column:
    original, masked = _field(df, "original_text"), _field(df, "masked_text")
    changed = F.when(original.isNull() | (masked != original), masked)
    return F.concat_ws(FIELD_BREAK, original, changed)


def search_messages(tagged: DataFrame, query: str) -> DataFrame:
    """Tagged messages for one question: by entity if it names one, else by text."""
    folded = query.strip().lower()
    tagged = known_columns(tagged, MESSAGE_FIELDS)
    flags = _entity_flags(F.col("pii_entities"))
    if "nric" in folded:
        match = flags["nric"]
    elif any(word in folded for word in ("salary", "income", "pay")):
        match = flags["salary"]
    elif "phone" in folded:
        match = flags["phone"]
    else:
        match = F.lower(_message_haystack(tagged)).contains(folded)
    return _shape(tagged.where(match), MESSAGE_FIELDS)


def _transaction_haystack(df: DataFrame) -> Column:
    narrative = F.concat_ws(" ", _field(df, "original_narrative"), _field(df, "masked_narrative"))
    tags = [F.col("aml_tags")] if "aml_tags" in df.columns else []
    return F.concat_ws(FIELD_BREAK, narrative, *tags)


def transaction_order() -> list[Column]:
    """Highest score first, then amount, then id; missing scores last."""
    return [F.desc_nulls_last("risk_score"), F.desc_nulls_last("amount_sgd"),
            F.asc("transaction_id")]


def search_transactions(tagged: DataFrame, query: str) -> DataFrame:
    """Tagged transactions for one question, best score first.

    A question that is just an id finds that transaction; if there is none it
    is searched as text like any other question.
    """
    folded = query.strip().lower()
    tagged = known_columns(tagged, TRANSACTION_FIELDS)
    haystack = F.lower(_transaction_haystack(tagged))
    word = next((hint for hint in ("crypto", "structuring") if hint in folded), folded)
    hits = tagged.where(haystack.contains(word))
    if re.fullmatch(r"t\d+", folded):
        exact = tagged.where(F.upper("transaction_id") == folded.upper())
        # At most one row: whether the id exists at all.
        exists = F.broadcast(exact.select(F.lit(1).alias("known")).limit(1))
        hits = hits.withColumn("known", F.lit(1)).join(exists, "known", "left_anti").drop("known")
        hits = exact.unionByName(hits)
    return _shape(hits, TRANSACTION_FIELDS).orderBy(*transaction_order())


def _obligation_text(df: DataFrame) -> Column:
    names = [n for n in ("regulation", "paragraph_text", "original_text") if n in df.columns]
    return F.lower(F.concat_ws(" ", *names))


def _notice_rule(df: DataFrame, source_token: str) -> Column:
    text = _obligation_text(df)
    source = F.lower(F.coalesce(F.col("source_document"), F.lit("")))
    about = source.contains(source_token) | text.contains("mas 610")
    return about & contains_any(text, ("suspicious", "str"))


def _asks_notice_rule(folded: Column) -> Column:
    return mentions_notice(folded) & contains_any(folded, ("suspicious", "str"))


def search_obligations(tagged: DataFrame, query: str, *, source_token: str = "610") -> DataFrame:
    """Tagged obligations for one question: the notice rule if it applies, or by text."""
    folded = query.strip().lower()
    match = _obligation_text(tagged).contains(folded)
    if "mas" in folded and "610" in folded and ("suspicious" in folded or "str" in folded):
        match = match | _notice_rule(tagged, source_token)
    return _shape(tagged.where(match), OBLIGATION_FIELDS)


def filter_obligations(tagged: DataFrame, *, source_document: str | None = None,
                       risk_type: str | None = None, missing_deadline: bool = False,
                       missing_owner: bool = False) -> DataFrame:
    """Structured filter; patterns ignore case, null never matches, all parts must hold."""
    for column, pattern in (("source_document", source_document), ("risk_type", risk_type)):
        if pattern:
            re.compile(pattern)
            tagged = tagged.where(F.col(column).rlike("(?iu)" + pattern))
    for column, wanted in (("deadline", missing_deadline), ("owner", missing_owner)):
        if wanted:
            tagged = tagged.where(is_missing(F.col(column)))
    return tagged


# --- search keys -----------------------------------------------------------

def _folded(questions: DataFrame) -> Column:
    return F.lower(strip(F.col("text")))


def message_keys(questions: DataFrame) -> DataFrame:
    """``question_id, search_key, term``; ``term`` is null for entity searches."""
    q = _folded(questions)
    entity = _entity_key(q)
    return questions.select(
        "question_id",
        F.coalesce(F.concat(F.lit("entity:"), entity), F.concat(F.lit(TEXT_KEY), q))
        .alias("search_key"),
        F.when(entity.isNull(), q).alias("term"),
    )


def transaction_keys(questions: DataFrame) -> DataFrame:
    """``question_id, search_key, term, wanted_id``."""
    q = _folded(questions)
    hint = F.when(q.contains("crypto"), "crypto").when(q.contains("structuring"), "structuring")
    return questions.select(
        "question_id",
        F.coalesce(F.concat(F.lit("hint:"), hint), F.concat(F.lit(TEXT_KEY), q))
        .alias("search_key"),
        F.when(hint.isNull(), q).alias("term"),
        F.when(q.rlike("^t[0-9]+$"), F.upper(q)).alias("wanted_id"),
    )


def obligation_keys(questions: DataFrame) -> DataFrame:
    """``question_id, search_key, term``: one row per search a question needs.

    A question the notice rule applies to needs two: the rule, and its text
    among the records the rule does not already give.
    """
    q = _folded(questions)
    rule = _asks_notice_rule(q)
    text_key = F.concat(F.when(rule, "besides rule:").otherwise(TEXT_KEY), q)
    null = F.lit(None).cast("string")
    searches = F.array(
        F.struct(text_key.alias("search_key"), q.alias("term")),
        F.when(rule, F.struct(F.lit("rule:notice").alias("search_key"), null.alias("term"))),
    )
    return questions.select("question_id", F.explode(searches).alias("s")) \
        .where("s is not null").select("question_id", "s.*")


def _fixed_keys(keys: DataFrame, prefix: str) -> DataFrame:
    """Distinct keys of a closed set (at most three values), safe to broadcast."""
    return F.broadcast(keys.where(F.col("search_key").startswith(prefix))
                       .select("search_key").distinct())


def _text_hits(records: DataFrame, record_id: str, haystack: Column, keys: DataFrame,
               regex: bool = False) -> DataFrame:
    """Records whose haystack contains a search term: record columns plus ``term``."""
    # Without terms the phrase side is empty and the join ends at once.
    terms = keys.where("term is not null").select("term").distinct()
    found = phrase_join(records.withColumn("haystack", haystack), record_id, "haystack",
                        terms, "term", regex=regex)
    return found.drop("haystack").withColumnRenamed("phrase", "term")


def match_messages(tagged: DataFrame, keys: DataFrame) -> DataFrame:
    """Hits per search key: ``search_key`` plus the message fields."""
    records = _shape(known_columns(tagged, MESSAGE_FIELDS), MESSAGE_FIELDS)
    flags = _entity_flags(F.col("pii_entities"))
    names = compact([(F.coalesce(flag, F.lit(False)), f"entity:{name}")
                     for name, flag in flags.items()])
    by_entity = records.select("*", F.explode(names).alias("search_key")) \
        .join(_fixed_keys(keys, "entity:"), "search_key", "left_semi")
    by_text = _text_hits(records, "message_id", _message_haystack(records), keys) \
        .withColumn("search_key", F.concat(F.lit(TEXT_KEY), "term"))
    return by_entity.unionByName(by_text.drop("term")).select("search_key", *MESSAGE_FIELDS)


def match_transactions(tagged: DataFrame, keys: DataFrame) -> DataFrame:
    """Hits per search key: ``search_key`` plus the transaction fields."""
    records = _shape(known_columns(tagged, TRANSACTION_FIELDS), TRANSACTION_FIELDS)
    haystack = F.lower(_transaction_haystack(records))
    names = compact([(haystack.contains("crypto"), "hint:crypto"),
                     (haystack.contains("structuring"), "hint:structuring")])
    by_hint = records.select("*", F.explode(names).alias("search_key")) \
        .join(_fixed_keys(keys, "hint:"), "search_key", "left_semi")

    out = ["search_key", *TRANSACTION_FIELDS]
    found, open_keys = by_hint.select(out), keys
    wanted = keys.where("wanted_id is not null").select("search_key", "wanted_id").distinct()
    if not wanted.isEmpty():
        # Found once and kept: the text search asks for the ids that are left over.
        by_id = materialise(records.withColumn("wanted_id", F.upper("transaction_id"))
                            .join(wanted, "wanted_id"), "transactions-by-id")
        known = by_id.select("search_key").distinct()
        found = found.unionByName(by_id.select(out))
        open_keys = keys.join(known, "search_key", "left_anti")
    by_text = _text_hits(records, "transaction_id", _transaction_haystack(records), open_keys) \
        .withColumn("search_key", F.concat(F.lit(TEXT_KEY), "term"))
    return found.unionByName(by_text.select(out))


def match_obligations(tagged: DataFrame, keys: DataFrame, *,
                      source_token: str = "610") -> DataFrame:
    """Hits per search key: ``search_key`` plus the obligation fields."""
    in_rule = _notice_rule(tagged, source_token)
    records = _shape(tagged.withColumn("in_rule", in_rule), OBLIGATION_FIELDS, "in_rule")
    by_rule = records.where("in_rule").withColumn("search_key", F.lit("rule:notice")) \
        .join(_fixed_keys(keys, "rule:"), "search_key", "left_semi")

    found = _text_hits(records, "paragraph_id", _obligation_text(records), keys)
    asks_rule = _asks_notice_rule(F.col("term"))
    by_text = found.where(~(asks_rule & F.col("in_rule"))).withColumn(
        "search_key", F.concat(F.when(asks_rule, "besides rule:").otherwise(TEXT_KEY), "term"))
    out = ["search_key", *OBLIGATION_FIELDS]
    return by_rule.select(out).unionByName(by_text.select(out))


def raw_keys(questions: DataFrame) -> DataFrame:
    """Raw mode searches the whole question as a pattern."""
    return questions.select("question_id", F.concat(F.lit("raw:"), "text").alias("search_key"),
                            F.col("text").alias("term"))


def match_raw(records: DataFrame, record_id: str, text: str, keys: DataFrame,
              fields: Sequence[str]) -> DataFrame:
    """All raw hits per search key: ``search_key, term`` and the fields."""
    found = _text_hits(_shape(records, fields), record_id, F.col(text), keys, regex=True)
    return found.select(F.concat(F.lit("raw:"), "term").alias("search_key"), "term", *fields)


def first_hits(hits: DataFrame, record_id: str, limit: int = K.RAW_HIT_LIMIT) -> DataFrame:
    """First ``limit`` hits, by id, per search key.  Narrow the hits before."""
    return ranked_first(hits, "search_key", [F.asc(record_id)], limit, "hit_rank").drop("hit_rank")


# --- results per question --------------------------------------------------

def per_question(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """Every (question, hit).  Hits that were aggregated or numbered by key: regroup them."""
    return keys.select("question_id", "search_key").join(hits, "search_key").drop("search_key")


def counts_per_question(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """``question_id, hit_count``, zero included; hits are counted once per key."""
    per_key = regrouped(hits.groupBy("search_key").agg(F.count("*").alias("n")), "search_key")
    return keys.join(per_key, "search_key", "left").groupBy("question_id").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("hit_count"))


def top_per_question(keys: DataFrame, hits: DataFrame, order: Sequence[Column],
                     n: int) -> DataFrame:
    """First ``n`` hits per question with ``rank``; at most ``n`` rows leave each key."""
    top = regrouped(ranked_first(hits, "search_key", order, n).drop("rank"), "search_key")
    return ranked_first(per_question(keys, top), "question_id", order, n)


# --- weak enrichment of raw hits -------------------------------------------

def weak_message_tags(hits: DataFrame) -> DataFrame:
    """Raw message hits with keyword labels and a crude risk; needs ``term``."""
    text = F.lower("text")
    labels = compact([(F.coalesce(text.contains(word), F.lit(False)), label)
                      for word, label in K.RAW_ENTITY_KEYWORDS])
    risk = (F.when(contains_any(text, K.RAW_HIGH_WORDS), "High")
            .when(text.contains(K.RAW_MEDIUM_WORD), "Medium").otherwise("Low"))
    return hits.withColumns({
        "pii_entities": F.when(F.size(labels) > 0, labels).otherwise(F.array("term")),
        "risk_flag": risk,
        "original_text": F.col("text"),
        "masked_text": F.lit(None).cast("string"),
    })


def weak_transaction_tags(hits: DataFrame) -> DataFrame:
    """Raw transaction hits with two keyword tags and no score; needs ``term``."""
    q, narrative = F.lower("term"), F.lower(F.coalesce("narrative", F.lit("")))
    tags = compact([
        (q.contains("crypto") | narrative.contains("crypto"), "Crypto"),
        (contains_any(q, ("structuring", "structured")) | narrative.contains("structuring"),
         "Structuring"),
    ])
    return hits.withColumns({
        "aml_tags": F.when(F.size(tags) > 0, tags).otherwise(F.array("term")),
        "risk_score": F.lit(None).cast("double"),
        "masked_narrative": F.lit(None).cast("string"),
        "original_narrative": F.col("narrative"),
    })


def raw_obligation_shape(hits: DataFrame) -> DataFrame:
    """Raw paragraph hits in the shape of tagged ones, without tags."""
    null = F.lit(None).cast("string")
    return hits.withColumns({
        "regulation": F.coalesce(F.nullif(F.col("regulation"), F.lit("")), "paragraph_text"),
        "owner": F.lit(K.NOT_TAGGED),
        "business_unit": F.lit(None).cast("array<string>"),
        "assigned_to": null,
        "deadline": null,
        "original_text": F.col("paragraph_text"),
    })
