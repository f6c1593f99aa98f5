"""Diagnosis codes as Column expressions: harmonise, describe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.functions.lookups import Profile, profile as resolve


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of ``key`` in a small fixed table, null when it has none.

    The table becomes one map literal of a few dozen entries, so the lookup
    stays inside the row's own stage: no join, no shuffle.
    """
    block = "\n".join(f"{name}={value}" for name, value in table.items())
    return F.try_element_at(F.str_to_map(F.lit(block), F.lit("\n"), F.lit("=")), key)


def chapter_letter(prefix: Column, which: str | Profile = "full") -> Column:
    """ICD-10 letter of a three-digit ICD-9 prefix, null outside all chapters.

    All chapter bounds have three digits, so digits are compared as text; a
    shorter or non-numeric prefix is in no chapter. (Casting would raise and
    catch an error for every code such as ``V85``.)
    """
    rules = resolve(which)
    letter = F.lit(None).cast("string")
    for low, high, name in rules.chapters:
        letter = F.when(prefix.between(str(low), str(high)), F.lit(name)).otherwise(letter)
    return F.when(prefix.rlike("^[0-9]{3}$"), letter)


def harmonized_code(code: Column, version: Column, which: str | Profile = "full") -> Column:
    """ICD-10 form of a code.

    Version 10 passes through (a null stays null). Everything else, including
    an unknown version, is read as ICD-9: exact map, then chapter range on the
    first three characters, then ``UNK_<code>``.
    """
    rules = resolve(which)
    text = F.coalesce(code, F.lit("nan"))
    prefix = F.substring(text, 1, 3)
    letter = chapter_letter(prefix, rules)
    body = text if rules.chapter_keeps_whole_code else prefix
    converted = F.coalesce(
        lookup(text, rules.code_map),
        F.concat(letter, body),
        F.concat(F.lit("UNK_"), text),
    )
    return F.when(F.coalesce(version == 10, F.lit(False)), code).otherwise(converted)


def code_description(code: Column, which: str | Profile = "full") -> Column:
    """Wording for a harmonised code; never null."""
    rules = resolve(which)
    text = F.coalesce(code, F.lit("nan"))
    category = F.substring(text, 1, 3)
    exact = lookup(category, rules.descriptions)
    if rules.describe_by_group:
        by_group = lookup(F.substring(text, 1, 2), rules.group_descriptions)
        return F.coalesce(exact, by_group, F.concat(F.lit("diagnosis code "), text))
    return F.coalesce(exact, F.concat(F.lit("diagnosis_"), category))
