"""Admission paragraph and text-token Column expressions."""

from __future__ import annotations

from collections.abc import Collection
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.functions import lookups

# The paragraph, and how much of a code list it shows.
PARAGRAPH = (
    "Patient is a {age} year old {gender} of {race} ethnicity. \n"
    "Admission type: {admission_type} from {admission_location}. \n"
    "Insurance: {insurance}. Marital status: {marital_status}.\n"
    "Admitted on a {day_kind} during {time_kind} hours.\n"
    "Number of diagnoses: {num_diagnoses}.\n"
    "Primary diagnoses include: {diagnoses}."
)
NO_DIAGNOSES = "no documented diagnoses"
CODES_SHOWN = 10
WORDINGS_SHOWN = 7

# Fixed value: a token is a run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def gender_word(gender: Column, which: str | lookups.Profile = "full") -> Column:
    rules = lookups.profile(which)
    word = F.when(gender == "F", F.lit("female"))
    if not rules.race_by_substring:
        word = word.when(gender == "M", F.lit("male"))
    return word.otherwise(F.lit(rules.unstated_gender))


def lower_or_nan(value: Column) -> Column:
    """Lower-case text; a missing value reads ``nan``."""
    return F.coalesce(F.lower(value.cast("string")), F.lit("nan"))


def wording_list(wordings: Column) -> Column:
    """Unique wordings of the first codes, in first-seen order, as one text."""
    shown = F.slice(F.array_distinct(F.slice(wordings, 1, CODES_SHOWN)), 1, WORDINGS_SHOWN)
    return F.when(F.size(wordings) > 0, F.array_join(shown, ", ")).otherwise(F.lit(NO_DIAGNOSES))


def _fill(template: str, values: dict[str, Column]) -> Column:
    """``str.format`` for Columns: literal pieces and values, concatenated."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(values[name])
    return F.concat(*pieces)


def clinical_text(columns: Collection[str], which: str | lookups.Profile = "full") -> Column:
    """Six-line paragraph of one admission.

    ``columns`` are the columns the frame has: one it lacks altogether reads
    ``unknown``, while a null cell reads ``nan``. ``diagnosis_wordings`` holds
    the described codes (see ``operators.diagnoses``).
    """

    def cell(name: str) -> Column:
        return lower_or_nan(F.col(name)) if name in columns else F.lit("unknown")

    def flag(name: str, yes: str, no: str) -> Column:
        if name not in columns:
            return F.lit(no)
        return F.when(F.col(name) == 1, F.lit(yes)).otherwise(F.lit(no))

    count = F.coalesce(F.col("num_diagnoses"), F.lit(0)) if "num_diagnoses" in columns else F.lit(0)
    gender = F.col("gender") if "gender" in columns else F.lit(None).cast("string")
    wordings = (
        wording_list(F.col("diagnosis_wordings")) if "diagnosis_wordings" in columns else F.lit(NO_DIAGNOSES)
    )
    values = {name: cell(name) for name in
              ("race", "admission_type", "admission_location", "insurance", "marital_status")}
    values |= {
        "age": cell("anchor_age"),
        "gender": gender_word(gender, which),
        "day_kind": flag("is_weekend", "weekend", "weekday"),
        "time_kind": flag("is_night_admission", "night", "day"),
        "num_diagnoses": count.cast("long").cast("string"),
        "diagnoses": wordings,
    }
    return F.trim(_fill(PARAGRAPH, values))


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of the whole text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def without_stop_words(words: Column, stop_words: Collection[str]) -> Column:
    stop = sorted(set(stop_words))
    return F.filter(words, lambda word: ~word.isin(stop)) if stop else words


def unigrams_and_bigrams(words: Column) -> Column:
    """Tokens followed by the space-joined pairs of neighbours."""
    others = F.slice(words, 2, F.size(words))
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(firsts, others, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)
