"""Rule taggers for messages, transactions and regulatory paragraphs.

All three are projections: no shuffle, no Python, one pass over the input.
Vocabularies and policies are arguments, so the same code serves any domain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.detectors import BANKING, Detector, detect, evaluate_once
from ledgerlens.functions.lists import compact
from ledgerlens.functions.risk import initial_risk, label_types, upgraded_risk
from ledgerlens.functions.text import strip


def tag_messages(messages: DataFrame, detectors: Sequence[Detector] = BANKING) -> DataFrame:
    """Entities, masked text and initial risk per message."""
    found = detect(messages, "text", detectors)
    tags = found.frame.select(
        F.col("message_id").cast("string").alias("message_id"),
        F.col("text").alias("original_text"),
        evaluate_once(
            found.masked.alias("masked_text"),
            found.labels.alias("pii_entities"),
            initial_risk(found.types).alias("risk_flag"),
        ),
    )
    return tags.select("message_id", "masked_text", "pii_entities", "risk_flag", "original_text")


def upgrade_risk(tagged: DataFrame, entities: str = "pii_entities",
                 risk: str = "risk_flag") -> DataFrame:
    """Apply the upgrade-only risk rules; a frame without entities is returned as it is."""
    if entities not in tagged.columns:
        return tagged
    current = F.col(risk) if risk in tagged.columns else F.lit(K.RISK_LEVELS[0])
    # One column per type flag, so that the rules do not test the labels again and again.
    flags = {f"__is_{name}": flag for name, flag in label_types(F.col(entities)).items()}
    types = {name: F.col(f"__is_{name}") for name in K.ENTITY_TYPE_WORDS}
    return tagged.withColumns(flags).withColumn(risk, upgraded_risk(types, current)).drop(*flags)


@dataclass(frozen=True)
class TransactionPolicy:
    """Typology patterns with weights, one amount band and amount steps."""

    typologies: tuple[tuple[str, str, int], ...] = K.BANKING_TYPOLOGIES
    band: tuple[str, str, float, float] = K.BANKING_AMOUNT_BAND
    steps: tuple[tuple[float, int], ...] = K.BANKING_AMOUNT_STEPS


TABLE_TRANSACTIONS = TransactionPolicy(
    K.TABLE_TYPOLOGIES, K.TABLE_AMOUNT_BAND, K.TABLE_AMOUNT_STEPS)


def tag_transactions(transactions: DataFrame, policy: TransactionPolicy = TransactionPolicy(),
                     detectors: Sequence[Detector] = BANKING) -> DataFrame:
    """Typology tags, score from 0 to 10, explanation and masked narrative per transaction."""
    found = detect(transactions, "narrative", detectors)
    narrative, amount = F.lower("narrative"), F.col("amount_sgd")
    band_tag, band_word, low, high = policy.band

    flagged: list[tuple[str, Column, int]] = []
    for tag, pattern, weight in policy.typologies:
        flag = narrative.rlike(pattern)
        if tag == band_tag:
            flag = flag | (narrative.contains(band_word) & (amount >= low) & (amount < high))
        flagged.append((tag, F.coalesce(flag, F.lit(False)), weight))

    step = F.when(F.lit(False), 0)
    for at_least, points in policy.steps:
        step = step.when(amount >= at_least, points)
    step = step.otherwise(0)
    score = F.lit(1) + step
    for _, flag, weight in flagged:
        score = score + F.when(flag, weight).otherwise(0)

    reasons = [F.when(flag, f"{tag} +{weight}") for tag, flag, weight in flagged]
    reasons.append(F.when(step > 0, F.concat(F.lit("amount +"), step.cast("string"))))
    explanation = F.concat_ws(", ", *reasons)
    tags = found.frame.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("narrative").alias("original_narrative"),
        amount.alias("amount_sgd"),
        F.col("date"),
        evaluate_once(
            found.masked.alias("masked_narrative"),
            found.labels.alias("pii_found"),
            compact([(flag, tag) for tag, flag, _ in flagged]).alias("aml_tags"),
            F.least(F.lit(10), score).cast("double").alias("risk_score"),
            F.when(explanation == "", "no typology found").otherwise(explanation)
            .alias("explanation"),
        ),
    )
    return tags.select("transaction_id", "masked_narrative", "pii_found", "aml_tags",
                       "risk_score", "explanation", "original_narrative", "amount_sgd", "date")


@dataclass(frozen=True)
class ObligationPolicy:
    """Keyword tables that turn a paragraph into obligation metadata."""

    risk_types: tuple[tuple[str, str], ...] = K.RISK_TYPE_RULES
    units: tuple[tuple[str, str], ...] = K.BUSINESS_UNIT_RULES
    owners: tuple[tuple[str, str], ...] = K.OWNER_RULES
    period: str = K.DEADLINE_PERIOD
    deadlines: tuple[tuple[str, str], ...] = K.DEADLINE_RULES
    default_risk_type: str = K.DEFAULT_RISK_TYPE
    default_owner: str = K.DEFAULT_OWNER


TABLE_OBLIGATIONS = ObligationPolicy(
    K.TABLE_RISK_TYPE_RULES, K.TABLE_BUSINESS_UNIT_RULES, K.TABLE_OWNER_RULES,
    K.TABLE_DEADLINE_PERIOD, K.TABLE_DEADLINE_RULES)


def _first_match(text: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    chain = F.when(F.lit(False), default)
    for pattern, label in rules:
        chain = chain.when(text.rlike(pattern), label)
    return chain.otherwise(default)


def tag_obligations(paragraphs: DataFrame,
                    policy: ObligationPolicy = ObligationPolicy()) -> DataFrame:
    """Regulation, article, risk type, units, owner and deadline per paragraph."""
    text = F.lower("paragraph_text")
    source = F.col("source_document")
    name = F.regexp_replace(source, K.SOURCE_SUFFIX, "")
    family = name.startswith(K.FAMILY_PREFIX + " ")
    rest = strip(F.substr(name, F.lit(len(K.FAMILY_PREFIX) + 1)))
    period = F.nullif(F.regexp_extract(text, policy.period, 1), F.lit(""))
    null = F.lit(None).cast("string")
    return paragraphs.select(
        F.col("paragraph_id").cast("string").alias("paragraph_id"),
        source,
        F.when(family, K.FAMILY_PREFIX).otherwise(name).alias("regulation"),
        F.when(family, rest).alias("article"),
        _first_match(text, policy.risk_types, F.lit(policy.default_risk_type)).alias("risk_type"),
        compact([(F.coalesce(text.rlike(p), F.lit(False)), unit) for p, unit in policy.units])
        .alias("business_unit"),
        _first_match(text, policy.owners, F.lit(policy.default_owner)).alias("owner"),
        F.coalesce(period, _first_match(text, policy.deadlines, null)).alias("deadline"),
        F.col("paragraph_text").alias("original_text"),
    )
