"""Risk policy expressions over canonical entity types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.lists import compact
from ledgerlens.functions.text import contains_any, strip


def rank_of(level: Column) -> Column:
    """Low 0 .. Critical 3; anything else, and null, -1."""
    folded = F.lower(level)
    chain = F.when(folded == K.RISK_LEVELS[0].lower(), 0)
    for rank, name in enumerate(K.RISK_LEVELS[1:], start=1):
        chain = chain.when(folded == name.lower(), rank)
    return chain.otherwise(-1)


def level_of(rank: Column) -> Column:
    """Inverse of :func:`rank_of`; out of range reads as Low."""
    chain = F.when(rank == 1, K.RISK_LEVELS[1])
    for number in (2, 3):
        chain = chain.when(rank == number, K.RISK_LEVELS[number])
    return chain.otherwise(K.RISK_LEVELS[0])


def label_types(labels: Column) -> dict[str, Column]:
    """One flag per canonical type for a list of entity labels.

    The labels are joined, one per line, so that every test is a plain string
    function inside generated code.
    """
    lines = F.lower(F.array_join(labels, "\n"))
    flags = {name: contains_any(lines, words) for name, words in K.ENTITY_TYPE_WORDS.items()}
    # An account label must not itself mention payroll; judge line by line.
    account = K.ENTITY_TYPE_WORDS["Account"][0]
    flags["Account"] = lines.rlike(f"(?m)^(?!.*{K.NOT_ACCOUNT_WORD}).*{account}")
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def canonical_types(labels: Column) -> Column:
    """List of canonical types found in a list of labels."""
    return compact([(flag, name) for name, flag in label_types(labels).items()])


class _Flags:
    """Reads a type flag, false for types the vocabulary does not know."""

    def __init__(self, types: Mapping[str, Column]):
        self._types = types
        self.count = sum((F.when(f, 1).otherwise(0) for f in types.values()), F.lit(0))

    def any_of(self, *names: str) -> Column:
        found = F.lit(False)
        for name in names:
            if name in self._types:
                found = found | self._types[name]
        return found


def initial_risk(types: Mapping[str, Column]) -> Column:
    """Policy applied when a message is first tagged."""
    has = _Flags(types)
    critical = (has.any_of("NRIC") & has.any_of("Account", "Salary", "Address")) | (has.count >= 3)
    high = has.any_of("NRIC", "Passport", "Account", "Address")
    medium = has.any_of("Salary", "Phone", "Email", "EmployeeID", "PayNow")
    return level_of(F.when(critical, 3).when(high, 2).when(medium, 1).otherwise(0))


def rule_rank(types: Mapping[str, Column]) -> Column:
    """Lowest rank the upgrade rules allow for these types; -1 for no rule."""
    has = _Flags(types)
    critical = (
        (has.any_of("NRIC") & has.any_of("Account", "Salary", "Address", "PayNow"))
        | (has.any_of("Passport") & has.any_of("Account"))
        | ((has.count >= 3) & has.any_of("NRIC", "Account", "Passport", "Salary"))
    )
    high = has.any_of("NRIC", "Passport", "Account", "PayNow") | (
        has.any_of("Salary") & has.any_of("Phone", "Email"))
    medium = has.any_of("Salary", "Phone", "Email", "EmployeeID")
    return F.when(critical, 3).when(high, 2).when(medium, 1).otherwise(-1)


def upgraded_risk(types: Mapping[str, Column], current: Column) -> Column:
    """Raise, never lower, a risk label by the rules; no rule keeps it as it is."""
    final = F.greatest(rank_of(current), rule_rank(types))
    applies = _Flags(types).any_of(*types) & (final >= 0)
    return F.when(applies, level_of(final)).otherwise(current)


def is_highlighted(level: Column) -> Column:
    return F.coalesce(F.lower(strip(level)).isin("high", "critical"), F.lit(False))
