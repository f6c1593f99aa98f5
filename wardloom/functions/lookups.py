"""Fixed lookup tables and the two rule profiles built from them."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. Results are only right with exactly these entries, and the
# order of the description tables matters (first entry of a two-character
# group is the fallback wording). One entry per line: key, space, value.
# ---------------------------------------------------------------------------

# ICD-9 code -> ICD-10 code, full profile.
FULL_CODE_MAP = """
4280 I50.9
4271 I49.9
42833 I50.33
42832 I50.32
42731 I48.91
42781 I49.9
4019 I10
41401 I25.10
4240 I34.0
4589 I95.9
4279 I51.9
42789 I49.9
486 J18.9
51881 J96.01
5070 J69.0
5119 J91.8
5180 J98.4
5185 J96.90
5849 N17.9
5859 N18.9
585 N18.9
2764 E87.1
2767 E87.5
2763 E87.0
2859 D64.9
25000 E11.9
2449 E03.9
99591 A41.9
99592 R65.20
0389 A49.9
5990 N39.0
2930 F05
33394 G47.33
43491 I63.9
5609 K56.60
56210 K63.1
5781 K92.1
1539 C18.9
71590 M25.50
73300 M81.0
73730 M62.81
45981 R60.9
3004 F41.1
V850 Z68.1
"""

# ICD-9 code -> ICD-10 code, compact profile.
COMPACT_CODE_MAP = """
4280 I50.9
4271 I49.9
42833 I50.33
42731 I48.91
4019 I10
41401 I25.10
486 J18.9
51881 J96.01
5070 J69.0
5849 N17.9
5859 N18.9
2764 E87.1
2859 D64.9
99591 A41.9
99592 R65.20
2930 F05
33394 G47.33
5609 K56.60
5781 K92.1
"""

# ICD-9 chapter: first and last three-digit prefix, ICD-10 letter.
FULL_CHAPTERS = """
240 279 E
290 319 F
320 389 G
390 459 I
460 519 J
520 579 K
580 629 N
"""

COMPACT_CHAPTERS = """
240 279 E
390 459 I
460 519 J
520 579 K
580 629 N
"""

# Three-character ICD-10 category -> wording, full profile.
FULL_DESCRIPTIONS = """
I50 heart failure
I49 cardiac arrhythmia
I48 atrial fibrillation
I10 hypertension
I25 coronary artery disease
I34 mitral valve disease
I95 hypotension
I51 heart disease
I63 stroke
J18 pneumonia
J96 respiratory failure
J69 aspiration pneumonia
J91 pleural effusion
J98 respiratory disorder
N17 acute kidney injury
N18 chronic kidney disease
N39 urinary tract infection
E87 electrolyte imbalance
D64 anemia
E11 diabetes
E03 hypothyroidism
A41 sepsis
A49 bacterial infection
R65 severe sepsis
F05 delirium
G47 sleep apnea
K56 bowel obstruction
K63 diverticulosis
K92 gastrointestinal bleeding
C18 colon cancer
M25 joint pain
M81 osteoporosis
M62 muscle weakness
R60 edema
F41 anxiety
Z68 body mass index finding
"""

# Three-character ICD-10 category -> wording, compact profile.
COMPACT_DESCRIPTIONS = """
I50 heart failure
I49 cardiac arrhythmia
I48 atrial fibrillation
I10 hypertension
I25 coronary artery disease
J18 pneumonia
J96 respiratory failure
J69 aspiration pneumonia
N17 acute kidney injury
N18 chronic kidney disease
E87 electrolyte imbalance
D64 anemia
A41 sepsis
R65 severe sepsis
F05 delirium
G47 sleep apnea
K56 bowel obstruction
K92 GI bleeding
E11 diabetes
"""

# Recorded race (upper case) = analysis group, full profile; others are Other.
RACE_GROUPS = """
WHITE = White
BLACK/AFRICAN AMERICAN = Black
BLACK/CARIBBEAN ISLAND = Black
HISPANIC/LATINO - PUERTO RICAN = Hispanic
HISPANIC/LATINO - GUATEMALAN = Hispanic
HISPANIC/LATINO - CUBAN = Hispanic
HISPANIC/LATINO - MEXICAN = Hispanic
HISPANIC/LATINO - DOMINICAN = Hispanic
HISPANIC/LATINO - SALVADORAN = Hispanic
HISPANIC/LATINO - CENTRAL AMERICAN = Hispanic
HISPANIC OR LATINO = Hispanic
ASIAN = Asian
ASIAN - CHINESE = Asian
ASIAN - ASIAN INDIAN = Asian
ASIAN - VIETNAMESE = Asian
ASIAN - KOREAN = Asian
OTHER = Other
UNKNOWN = Unknown
UNABLE TO OBTAIN = Unknown
PATIENT DECLINED TO ANSWER = Unknown
"""

# Substrings of the upper-case recorded race = analysis group, compact
# profile. Tested top to bottom; others are Other.
RACE_SUBSTRINGS = """
WHITE = White
BLACK = Black
AFRICAN = Black
HISPANIC = Hispanic
LATINO = Hispanic
ASIAN = Asian
UNKNOWN = Unknown
UNABLE = Unknown
"""

# Cell texts that mean "missing" when a CSV is read.
NA_TOKENS = """
#N/A
#N/A N/A
#NA
-1.#IND
-1.#QNAN
-NaN
-nan
1.#IND
1.#QNAN
<NA>
N/A
NA
NULL
NaN
None
n/a
nan
null
"""

# Default English stop words (those that can be a token of two or more word
# characters). A parameter of the text features, not a rule of theirs.
ENGLISH_STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing an the and but if or because
as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very can will just
don should now cannot could ought would
"""

# Cohort columns kept for modelling; the compact profile keeps the first nine.
COHORT_COLUMNS = """
hadm_id subject_id clinical_text hospital_expire_flag los_days race gender
anchor_age num_diagnoses admission_type insurance
"""

# Model settings.
BOOSTING_TREES = 200
BOOSTING_DEPTH = 5
BOOSTING_RATE = 0.1
MAX_TERMS = 5000
MAX_LENGTH = 256
SEED = 42
HEAD_WIDTH = 256
HEAD_INNER_WIDTH = 64
HEAD_EPOCHS = 5
HEAD_RATE = 2e-5
HEAD_DECAY = 0.01
HEAD_WARM_UP = 0.1
HEAD_CLIP = 1.0
DISPARITY_LIMIT = 0.1
OUTCOME_NAMES = ("Survived", "Expired")

# ---------------------------------------------------------------------------


def entries(block: str, separator: str = " ") -> dict[str, str]:
    """Parse a ``key<separator>value`` block, keeping its order."""
    pairs = (line.split(separator, 1) for line in block.strip().splitlines())
    return {key: value for key, value in pairs}


def na_tokens() -> list[str]:
    return ["", *NA_TOKENS.strip().splitlines()]


def stop_words() -> list[str]:
    return ENGLISH_STOP_WORDS.split()


@dataclass(frozen=True)
class Profile:
    """One consistent set of rules; ``FULL`` and ``COMPACT`` are the two."""

    name: str
    code_map: dict[str, str]
    chapters: tuple[tuple[int, int, str], ...]
    descriptions: dict[str, str]
    # chapter codes keep the whole source code, or only its 3-char prefix
    chapter_keeps_whole_code: bool
    # unknown categories: try the 2-char group and spell out the code, or not
    describe_by_group: bool
    unstated_gender: str
    cohort_columns: tuple[str, ...]
    required_columns: tuple[str, ...]
    race_by_substring: bool
    min_group_size: int

    @property
    def group_descriptions(self) -> dict[str, str]:
        """First wording of every two-character group."""
        first: dict[str, str] = {}
        for category, wording in self.descriptions.items():
            first.setdefault(category[:2], wording)
        return first


def _chapters(block: str) -> tuple[tuple[int, int, str], ...]:
    rows = (line.split() for line in block.strip().splitlines())
    return tuple((int(low), int(high), letter) for low, high, letter in rows)


FULL = Profile(
    name="full",
    code_map=entries(FULL_CODE_MAP),
    chapters=_chapters(FULL_CHAPTERS),
    descriptions=entries(FULL_DESCRIPTIONS),
    chapter_keeps_whole_code=False,
    describe_by_group=True,
    unstated_gender="unknown gender",
    cohort_columns=tuple(COHORT_COLUMNS.split()),
    required_columns=("clinical_text", "hospital_expire_flag"),
    race_by_substring=False,
    min_group_size=50,
)

COMPACT = Profile(
    name="compact",
    code_map=entries(COMPACT_CODE_MAP),
    chapters=_chapters(COMPACT_CHAPTERS),
    descriptions=entries(COMPACT_DESCRIPTIONS),
    chapter_keeps_whole_code=True,
    describe_by_group=False,
    unstated_gender="male",
    cohort_columns=tuple(COHORT_COLUMNS.split())[:9],
    required_columns=("clinical_text", "hospital_expire_flag", "los_days"),
    race_by_substring=True,
    min_group_size=30,
)


def profile(which: str | Profile) -> Profile:
    if isinstance(which, Profile):
        return which
    try:
        return {"full": FULL, "compact": COMPACT}[which]
    except KeyError:
        raise ValueError(f"profile must be 'full' or 'compact', not {which!r}") from None
