"""Analysis groups for the fairness tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.functions.codes import lookup


def race_group_exact(race: Column) -> Column:
    """Group by exact (case-blind) recorded value; anything else is Other."""
    return F.coalesce(lookup(F.upper(race), lookups.entries(lookups.RACE_GROUPS, " = ")), F.lit("Other"))


def race_group_substring(race: Column) -> Column:
    """Group by the first listed substring found; a null is Other.

    The test order is kept as is, so ``CAUCASIAN`` lands in Asian.
    """
    text = F.upper(race)
    tests = lookups.entries(lookups.RACE_SUBSTRINGS, " = ")
    group = F.lit("Other")
    for part, name in reversed(tests.items()):
        group = F.when(text.contains(part), F.lit(name)).otherwise(group)
    return group


def race_group(race: Column, which: str | lookups.Profile = "full") -> Column:
    rules = lookups.profile(which)
    return race_group_substring(race) if rules.race_by_substring else race_group_exact(race)
