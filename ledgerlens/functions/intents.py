"""Question routing expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.lists import compact
from ledgerlens.functions.text import contains_any

TRANSACTION_ID = "\\bT[0-9]+\\b"


def mentions_notice(folded: Column) -> Column:
    """The question names the notice, together or as two words."""
    return folded.contains("mas 610") | (folded.contains("mas") & folded.contains("610"))


def route(question: Column, *, strict: bool = False) -> Column:
    """One intent per question, first rule that fits.

    ``strict`` asks for the one fixed transaction id in report requests;
    otherwise any transaction id will do.
    """
    q = F.lower(question)
    pii = contains_any(q, K.PII_INTENT_WORDS)
    aml = contains_any(q, K.AML_INTENT_WORDS) | (q.contains("transactions") & q.contains("risk"))
    reg = contains_any(q, K.REG_INTENT_PHRASES) | mentions_notice(q)
    named = q.contains(K.SAR_STRICT_ID) if strict else (transaction_id(question) != "")
    return (
        F.when(pii, K.PII_SEARCH)
        .when(aml, K.AML_SEARCH)
        .when(reg, K.REG_SEARCH)
        .when(q.contains("sar") & named, K.SAR_DRAFT)
        .otherwise(K.OUT_OF_SCOPE)
    )


def transaction_id(question: Column) -> Column:
    """First transaction id in the question, empty when there is none."""
    return F.regexp_extract(F.upper(question), TRANSACTION_ID, 0)


def all_intents(question: Column) -> Column:
    """Every intent whose trigger words occur, OUT_OF_SCOPE when none does.

    A transaction id alone asks for transactions, unless the question asks to
    draft or file a report.
    """
    q = F.lower(question)
    has_id = transaction_id(question) != ""
    sar = contains_any(q, K.SAR_TRIGGERS) | (has_id & q.rlike("\\b(sar|str)\\b"))
    found = [
        (contains_any(q, K.PII_TRIGGERS) | q.rlike("\\bic\\b"), K.PII_SEARCH),
        (contains_any(q, K.AML_TRIGGERS) | (has_id & ~sar), K.AML_SEARCH),
        (contains_any(q, K.REG_TRIGGERS) | mentions_notice(q), K.REG_SEARCH),
        (sar, K.SAR_DRAFT),
    ]
    intents = compact(found)
    return F.when(F.size(intents) == 0, F.array(F.lit(K.OUT_OF_SCOPE))).otherwise(intents)


def report_kind(question: Column) -> Column:
    """'coverage' or 'missing' for the two structured obligation questions, else null."""
    q = F.lower(question)
    topic = contains_any(q, ("mas 610", "mas notice 610")) & q.contains("suspicious")
    coverage = contains_any(q, ("how many", "count")) & q.contains("deadline")
    missing = (
        contains_any(q, ("show", "list"))
        & q.contains("missing")
        & contains_any(q, ("owner", "deadline"))
    )
    return F.when(topic & coverage, "coverage").when(topic & missing, "missing")
