"""Explicit schemas of raw and tagged tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, DoubleType, StringType, StructField, StructType)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _D, _L = StringType(), DoubleType(), ArrayType(StringType())

RAW_MESSAGES = _schema(message_id=_S, channel=_S, date=_S, text=_S)
RAW_TRANSACTIONS = _schema(transaction_id=_S, date=_S, amount_sgd=_D, currency=_S, narrative=_S)
RAW_PARAGRAPHS = _schema(paragraph_id=_S, source_document=_S, paragraph_text=_S)
# What an absent paragraph file reads as: tag columns included, all null.
EMPTY_PARAGRAPHS = _schema(paragraph_id=_S, source_document=_S, regulation=_S, article=_S,
                           paragraph_text=_S)

TAGGED_MESSAGES = _schema(message_id=_S, masked_text=_S, pii_entities=_L, risk_flag=_S,
                          original_text=_S)
TAGGED_TRANSACTIONS = _schema(
    transaction_id=_S, masked_narrative=_S, pii_found=_L, aml_tags=_L, risk_score=_D,
    explanation=_S, original_narrative=_S, amount_sgd=_D, date=_S)
TAGGED_OBLIGATIONS = _schema(
    paragraph_id=_S, source_document=_S, regulation=_S, article=_S, risk_type=_S,
    business_unit=_L, owner=_S, deadline=_S, original_text=_S)
VECTORS = "id string, vector array<float>"
