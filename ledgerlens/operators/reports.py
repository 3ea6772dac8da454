"""Reports as tables of lines.

A report is rows of ``question_id, section, ord, line``; sorted by section and
ord and joined with newlines they are the text.  A report that lists every hit
can be as long as the data, so its lines stay distributed and are never
gathered into one string.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.intents import report_kind, transaction_id
from ledgerlens.functions.risk import rank_of
from ledgerlens.functions.text import (
    excerpt, first_present, is_missing, joined_or_default, metric_label, number_text, plain_number,
    strip)
from ledgerlens.operators.metrics import (
    deadline_coverage, lacks_owner_or_deadline, missing_split, risk_summary)
from ledgerlens.operators.search import (
    counts_per_question, filter_obligations, ranked_first, top_per_question, transaction_order)
from ledgerlens.sources.storage import regrouped

LINE_COLUMNS = ("question_id", "section", "ord", "line")


def _line(section: int, line: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit("").alias("ord"), line.alias("line"))


def _head(totals: DataFrame, total: str, headline: str, summary: Column) -> DataFrame:
    """Headline and total line, or the fixed sentence when there are no hits."""
    lines = F.when(F.coalesce(F.col(total), F.lit(0)) == 0,
                   F.array(_line(0, F.lit(K.NO_RESULTS)))) \
        .otherwise(F.array(_line(0, F.lit(headline)), _line(1, summary)))
    return totals.select("question_id", F.inline(lines))


def _with_excerpt(head: Column, label: str, text: Column) -> Column:
    return F.when(text == "", head).otherwise(F.concat(head, F.lit("\n" + label), text))


# What a report shows of a hit.  Whole texts are cut to their excerpt before hits are kept,
# ranked or joined, so that no step after the search carries them.

def shown_messages(hits: DataFrame) -> DataFrame:
    return hits.select(
        "search_key", "message_id", "risk_flag",
        joined_or_default(F.col("pii_entities"), K.NOT_PROVIDED).alias("labels"),
        excerpt(first_present(F.col("masked_text"), F.col("original_text")), K.PII_EXCERPT_CHARS)
        .alias("excerpt"))


def shown_transactions(hits: DataFrame) -> DataFrame:
    narrative = first_present(F.col("masked_narrative"), F.col("original_narrative"))
    return hits.select(
        "search_key", "transaction_id", "amount_sgd", "risk_score",
        joined_or_default(F.col("aml_tags"), K.NOT_PROVIDED).alias("labels"),
        excerpt(narrative, K.AML_EXCERPT_CHARS).alias("excerpt"))


def shown_obligations(hits: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``details`` gives other columns of the obligations, by ``paragraph_id``."""
    regulation = first_present(F.col("regulation"), F.col("source_document"))
    text = F.coalesce(first_present(F.col("paragraph_text"), F.col("original_text")),
                      F.lit(K.NOT_PROVIDED))
    known = [] if details is None else details.columns
    # Joined with the short columns only; whole texts are not moved.
    shown = hits.select(
        "search_key", "paragraph_id",
        strip(F.coalesce(regulation, F.lit(""))).alias("regulation"),
        excerpt(text, K.REG_EXCERPT_CHARS).alias("excerpt"),
        *[c for c in ("owner", "business_unit", "assigned_to") if c in hits.columns
          and c not in known])
    if details is not None:
        shown = shown.join(details, "paragraph_id", "left")
    return shown.select("search_key", "paragraph_id", "regulation", "excerpt",
                        owner_or_units(shown, K.NOT_PROVIDED).alias("owner"))


def message_line() -> Column:
    head = F.format_string(
        K.PII_HIT, F.coalesce("message_id", F.lit("-")),
        F.coalesce(F.nullif("risk_flag", F.lit("")), F.lit(K.NOT_PROVIDED)), "labels")
    return _with_excerpt(head, K.PII_EXCERPT, F.col("excerpt"))


def message_report(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """Headline, totals by risk and one line per hit; ``hits`` as shown."""
    totals = keys.join(regrouped(risk_summary(hits, "search_key"), "search_key"),
                       "search_key", "left")
    summary = F.format_string(K.PII_TOTAL, "total", "critical", "high", "medium", "low")
    lines = hits.select("search_key", F.lit(2).alias("section"),
                        F.col("message_id").alias("ord"), message_line().alias("line"))
    return _head(totals, "total", K.PII_HEADLINE, summary).unionByName(
        keys.join(lines, "search_key").select(*LINE_COLUMNS))


def _ranked_lines(keys: DataFrame, hits: DataFrame, order: Sequence[Column],
                  line: Column) -> DataFrame:
    top = top_per_question(keys, hits, order, K.REPORT_ROWS)
    return top.select("question_id", F.lit(2).alias("section"),
                      F.lpad(F.col("rank").cast("string"), 2, "0").alias("ord"),
                      line.alias("line"))


def _shown(template: str) -> Column:
    return F.format_string(template, "hit_count", F.least("hit_count", F.lit(K.REPORT_ROWS)))


def transaction_line() -> Column:
    amount = F.when(F.col("amount_sgd").isNull(), "").otherwise(
        F.concat(F.lit(" | SGD "), number_text(F.col("amount_sgd"))))
    risk = F.when(F.col("risk_score").isNull(), K.NOT_PROVIDED).otherwise(
        F.concat(number_text(F.col("risk_score")), F.lit("/10")))
    head = F.concat(
        F.lit("\n• **"), F.coalesce("transaction_id", F.lit(K.NOT_PROVIDED)), F.lit("**"), amount,
        F.lit(" | Risk: **"), risk, F.lit("**\n  Tags: "), "labels")
    return _with_excerpt(head, K.AML_NARRATIVE, F.col("excerpt"))


def transaction_report(keys: DataFrame, hits: DataFrame,
                       order: Sequence[Column] | None = None) -> DataFrame:
    """Headline, total and the first 20 transactions, best score first."""
    counts = counts_per_question(keys, hits)
    return _head(counts, "hit_count", K.AML_HEADLINE, _shown(K.AML_TOTAL)).unionByName(
        _ranked_lines(keys, hits, order or transaction_order(), transaction_line()))


def owner_or_units(hits: DataFrame, default: str) -> Column:
    """Owner, else the units joined by commas, else who it is assigned to, else ``default``."""
    units = F.col("business_unit")
    if hits.schema["business_unit"].dataType.simpleString().startswith("array"):
        units = F.array_join(units, ", ")
    last = [strip(F.col("assigned_to"))] if "assigned_to" in hits.columns else []
    return F.coalesce(first_present(strip(F.col("owner")), strip(units), *last), F.lit(default))


def obligation_line() -> Column:
    prefix = F.when(F.col("regulation") == "", "").otherwise(
        F.concat(F.lit("["), "regulation", F.lit("] ")))
    return F.concat(F.lit("\n• "), prefix, "excerpt", F.lit("\n  Owner: **"), "owner",
                    F.lit("**"))


def obligation_report(keys: DataFrame, hits: DataFrame) -> DataFrame:
    """Headline, total and the first 20 obligations by id."""
    counts = counts_per_question(keys, hits)
    return _head(counts, "hit_count", K.REG_HEADLINE, _shown(K.REG_TOTAL)).unionByName(
        _ranked_lines(keys, hits, [F.asc("paragraph_id")], obligation_line()))


def snapshot_report(metrics: DataFrame) -> DataFrame:
    """``section, ord, line`` of the obligation metrics: preferred ones, then by name.

    Breakdowns and zero values are left out; without any line there is no report.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in K.SNAPSHOT_ORDER]), F.col("metric"))
    shown = metrics.where(F.col("metric").contains("reg") & (F.col("label") == "")
                          & (F.col("value") != 0))
    lines = shown.select(
        F.when(place > 0, place).otherwise(len(K.SNAPSHOT_ORDER) + 1).cast("int").alias("section"),
        F.col("metric").alias("ord"),
        F.concat(F.lit("- "), metric_label(F.col("metric")), F.lit(": "),
                 plain_number(F.col("value"))).alias("line"))
    head = lines.agg(F.count("*").alias("n")).where("n > 0").select(
        F.lit(0).alias("section"), F.lit("").alias("ord"),
        F.lit(K.SNAPSHOT_HEADLINE).alias("line"))
    return head.unionByName(lines)


# --- structured obligation answers -----------------------------------------

@dataclass(frozen=True)
class Topic:
    """The obligations the two structured questions are about (patterns)."""

    source_document: str = K.TOPIC_SOURCE
    risk_type: str = K.TOPIC_RISK

    def rows(self, tagged: DataFrame) -> DataFrame:
        return filter_obligations(tagged, source_document=self.source_document,
                                  risk_type=self.risk_type)


def obligation_examples(obligations: DataFrame, n: int) -> DataFrame:
    """First ``n`` obligations by id, with their short text."""
    name = first_present(*[F.col(c) for c in ("regulation", "paragraph_text")
                           if c in obligations.columns])
    return obligations.select(
        F.coalesce("paragraph_id", F.lit(K.NO_ID)).alias("paragraph_id"),
        F.substring(F.coalesce(name, F.lit("")), 1, K.EXAMPLE_CHARS).alias("excerpt"),
        *[F.when(is_missing(F.col(c)), K.MISSING).otherwise(F.col(c)).alias(c)
          for c in ("owner", "deadline")],
    ).orderBy("paragraph_id").limit(n)


def _example_text(examples: DataFrame, line: Column) -> DataFrame:
    """The few example lines as one value; the input is already limited."""
    return examples.select(F.struct("paragraph_id", line.alias("line")).alias("e")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n")
        .alias("examples"))


def _one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two single-row aggregates."""
    return left.withColumn("one", F.lit(1)).join(
        F.broadcast(right.withColumn("one", F.lit(1))), "one").drop("one")


def coverage_answer(obligations: DataFrame) -> DataFrame:
    """How many of these obligations have a deadline: ``kind, hit_count, line``."""
    examples = _example_text(
        obligation_examples(obligations, K.COVERAGE_ROWS),
        F.concat(F.lit("- "), "paragraph_id", F.lit(": "), "excerpt"))
    text = F.concat(
        F.format_string(K.COVERAGE_TOTAL, "total", "with_deadline", "without_deadline"),
        F.lit(K.COVERAGE_EXAMPLES), "examples")
    return _one_row_join(deadline_coverage(obligations), examples).select(
        F.lit("coverage").alias("kind"), F.col("total").alias("hit_count"),
        F.when(F.col("total") == 0, K.TOPIC_NONE).otherwise(text).alias("line"))


def missing_answer(obligations: DataFrame) -> DataFrame:
    """Which of these obligations lack owner or deadline: ``kind, hit_count, line``."""
    examples = _example_text(
        obligation_examples(obligations.where(lacks_owner_or_deadline()), K.MISSING_ROWS),
        F.concat(F.lit("- "), "paragraph_id", F.lit(": "), "excerpt", F.lit(" … | owner="),
                 "owner", F.lit(", deadline="), "deadline"))
    shown = F.when(F.col("missing_count") > 0,
                   F.concat(F.lit(K.MISSING_EXAMPLES), "examples")).otherwise("")
    text = F.concat(F.format_string(K.MISSING_TOTAL, "total", "missing_count"), shown)
    return _one_row_join(missing_split(obligations), examples).select(
        F.lit("missing").alias("kind"), F.col("total").alias("hit_count"),
        F.when(F.col("total") == 0, K.TOPIC_NONE).otherwise(text).alias("line"))


def structured_answers(questions: DataFrame, tagged: DataFrame, topic: Topic) -> DataFrame:
    """``question_id, hit_count, line`` for the questions of a structured kind."""
    rows = topic.rows(tagged)
    answers = coverage_answer(rows).unionByName(missing_answer(rows))
    # Two rows, one per kind.
    return questions.withColumn("kind", report_kind(F.col("text"))) \
        .join(F.broadcast(answers), "kind").select("question_id", "hit_count", "line")


# --- activity report drafts ------------------------------------------------

def draft_requests(questions: DataFrame) -> DataFrame:
    """``question_id, wanted_id``: the id in the question or the default one."""
    return questions.select("question_id", F.coalesce(
        F.nullif(transaction_id(F.col("text")), F.lit("")),
        F.lit(K.DEFAULT_TRANSACTION_ID)).alias("wanted_id"))


def sar_drafts(requests: DataFrame, tagged: DataFrame) -> DataFrame:
    """One draft per request from the tagged transaction; fixed text when there is none."""
    amount = F.coalesce(number_text(F.col("amount_sgd")), F.lit(K.NOT_PROVIDED))
    risk = F.when(F.col("risk_score").isNull(), K.NOT_PROVIDED).otherwise(
        F.concat(number_text(F.col("risk_score")), F.lit("/10")))
    narrative = first_present(F.col("masked_narrative"), F.col("original_narrative"))
    body = F.concat(
        F.lit("Amount: SGD "), amount,
        F.lit("\nTypology: "), joined_or_default(F.col("aml_tags"), K.NOT_PROVIDED),
        F.lit("\nRisk: "), risk,
        F.coalesce(F.concat(F.lit("\nNarrative: "), narrative), F.lit("")))
    records = tagged.withColumn("wanted_id", F.upper("transaction_id"))
    joined = requests.join(records, "wanted_id", "left")
    best = ranked_first(joined, "question_id", transaction_order(), 1)
    return best.select(
        "question_id", F.col("wanted_id").alias("transaction_id"),
        F.when(F.col("transaction_id").isNull(), K.NO_SAR).otherwise(body).alias("sar_draft"))


def raw_sar_drafts(requests: DataFrame) -> DataFrame:
    """The raw mode never drafts."""
    return requests.select("question_id", F.col("wanted_id").alias("transaction_id"),
                           F.lit(K.NO_SAR_RAW).alias("sar_draft"))


def sar_report(drafts: DataFrame) -> DataFrame:
    return drafts.select("question_id", F.inline(F.array(
        _line(0, F.concat(F.lit("**SAR Drafted for "), "transaction_id", F.lit("**"))),
        _line(1, F.col("sar_draft")))))


def top_messages_by_risk(tagged: DataFrame, n: int = K.TOP_RANKED) -> DataFrame:
    """First ``n`` messages, Critical first, then by id."""
    return tagged.orderBy(F.desc(rank_of(F.col("risk_flag"))), "message_id").limit(n)


def ranked_transactions(tagged: DataFrame) -> DataFrame:
    """All transactions, highest score first; Spark sorts them in ranges."""
    return tagged.orderBy(*transaction_order())


def top_transactions(tagged: DataFrame, n: int = K.TOP_RANKED) -> DataFrame:
    return ranked_transactions(tagged).limit(n)
