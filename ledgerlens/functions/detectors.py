"""Pattern detectors that find and mask entities in free text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.lists import compact


@dataclass(frozen=True)
class Detector:
    """One entity: ``needle`` is a literal every match contains, if there is one."""

    label: str
    entity_type: str
    pattern: str
    replacement: str
    needle: str | None = None

    def mask(self, text: Column) -> Column:
        masked = F.regexp_replace(text, self.pattern, self.replacement)
        if self.needle is None:
            return masked
        # A substring test is far cheaper than the pattern on text without a match.
        return F.when(text.contains(self.needle), masked).otherwise(text)


BANKING = tuple(Detector(*row) for row in K.BANKING_DETECTORS)
TABLES = tuple(Detector(*row) for row in K.TABLE_DETECTORS)


@dataclass(frozen=True)
class Detected:
    """Result of :func:`detect`: the frame plus expressions over its work columns."""

    frame: DataFrame
    masked: Column
    labels: Column
    types: dict[str, Column]
    work_columns: tuple[str, ...]


def detect(df: DataFrame, text: str, detectors: Sequence[Detector]) -> Detected:
    """Mask ``text`` detector by detector.

    An entity is present when its own step changed the text, so a value that
    fits two patterns counts once, for the first.  Each step is a column of its
    own; one long expression would evaluate the earlier patterns again for
    every flag.
    """
    current = text
    work: list[str] = []
    flags: list[Column] = []
    for number, detector in enumerate(detectors):
        step = f"__{text}_{number}"
        df = df.withColumn(step, detector.mask(F.col(current)))
        flags.append(F.coalesce(F.col(step) != F.col(current), F.lit(False)))
        work.append(step)
        current = step
    types: dict[str, list[Column]] = {}
    for detector, flag in zip(detectors, flags):
        types.setdefault(detector.entity_type, []).append(flag)
    return Detected(
        frame=df,
        masked=F.col(current),
        labels=compact([(flag, d.label) for d, flag in zip(detectors, flags)]),
        types={name: reduce(or_, found) for name, found in types.items()},
        work_columns=tuple(work),
    )


def evaluate_once(*columns: Column) -> Column:
    """The columns as the output of a one-row generator.

    A filter on a tag would otherwise be pushed below the projection with the
    whole chain of patterns copied into it, and every pattern would run several
    times per row.  Filters are not pushed into a generator.
    """
    return F.inline(F.array(F.struct(*columns)))


def mask_text(df: DataFrame, text: str, detectors: Sequence[Detector],
              masked: str = "masked_text") -> DataFrame:
    """Add the masked form of ``text``."""
    found = detect(df, text, detectors)
    return found.frame.withColumn(masked, found.masked).drop(*found.work_columns)
