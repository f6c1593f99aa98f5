import pytest
from pyspark.sql import functions as F

from wardloom.functions.codes import code_description, harmonized_code
from wardloom.functions.lookups import COMPACT, FULL, profile

# (version, code, full, compact)
CODES = [
    (9, "4280", "I50.9", "I50.9"),
    (9, "0389", "A49.9", "UNK_0389"),
    (9, "4281", "I428", "I4281"),
    (9, "2959", "F295", "UNK_2959"),
    (9, "3200", "G320", "UNK_3200"),
    (9, "2400", "E240", "E2400"),
    (9, "2799", "E279", "E2799"),
    (9, "2800", "UNK_2800", "UNK_2800"),
    (9, "5199", "J519", "J5199"),
    (9, "5200", "K520", "K5200"),
    (9, "6299", "N629", "N6299"),
    (9, "6300", "UNK_6300", "UNK_6300"),
    (9, "E9300", "UNK_E9300", "UNK_E9300"),
    (9, "25", "UNK_25", "UNK_25"),
    (9, "V850", "Z68.1", "UNK_V850"),
    (9, " 428", "UNK_ 428", "UNK_ 428"),
    (9, "", "UNK_", "UNK_"),
    (10, "4280", "4280", "4280"),
    (10, None, None, None),
    (9, None, "UNK_nan", "UNK_nan"),
    (None, "4280", "I50.9", "I50.9"),
    (None, None, "UNK_nan", "UNK_nan"),
]


@pytest.mark.parametrize("which,place", [("full", 2), ("compact", 3)])
def test_harmonized(rows, which, place):
    df = rows([(i, v, c) for i, (v, c, *_) in enumerate(CODES)], "i int, v int, c string")
    got = df.select("i", harmonized_code(F.col("c"), F.col("v"), which).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: row[place] for i, row in enumerate(CODES)}


DESCRIPTIONS = {
    "full": {
        "I50.9": "heart failure", "I428": "cardiac arrhythmia", "R609": "edema", "R659": "severe sepsis",
        "R611": "severe sepsis", "K92.1": "gastrointestinal bleeding", "UNK_25": "diagnosis code UNK_25",
        "Q999": "diagnosis code Q999", None: "diagnosis code nan", "I5": "heart failure", "I": "diagnosis code I",
        "4280": "diagnosis code 4280",
    },
    "compact": {
        "I50.9": "heart failure", "I4281": "diagnosis_I42", "K92.1": "GI bleeding", "UNK_25": "diagnosis_UNK",
        "I5": "diagnosis_I5", None: "diagnosis_nan", "4280": "diagnosis_428",
    },
}


@pytest.mark.parametrize("which", ["full", "compact"])
def test_described(rows, which):
    expected = DESCRIPTIONS[which]
    df = rows([(c,) for c in expected], "c string")
    got = {r.c: r.d for r in df.select("c", code_description(F.col("c"), which).alias("d")).collect()}
    assert got == expected


def test_profiles():
    assert (len(FULL.code_map), len(COMPACT.code_map)) == (44, 19)
    assert (len(FULL.descriptions), len(COMPACT.descriptions)) == (36, 19)
    assert (len(FULL.chapters), len(COMPACT.chapters)) == (7, 5)
    assert COMPACT.cohort_columns == FULL.cohort_columns[:9]
    assert FULL.group_descriptions["I4"] == "cardiac arrhythmia"
    with pytest.raises(ValueError):
        profile("other")
