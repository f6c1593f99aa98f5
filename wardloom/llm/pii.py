"""Personal data by weak supervision.

Fixed patterns find the certain spans (``base_spans``). Wider patterns find
candidates for the same kinds and for names: numbers with other separators,
addresses spelled out, capitalised pairs. Four labelers vote on each candidate
(yes, no, nothing to say):

    form       the fixed pattern and its check digits or ranges
    gazetteer  known domains, issuers, calling codes, given names
    context    words before it that speak for or against its kind
    shape      how it is grouped and spread

No candidate has a true label. For each kind, expectation-maximisation over
the counts of vote patterns estimates the share of true spans and, for each
labeler, how often it votes what on true and on other spans; spans of the fixed
patterns are true, and no labeler counts as worse than chance. That gives every
candidate a probability, on which a span classifier (logistic regression over
hashed features of the span and the words around it) is trained. A candidate
that the classifier takes for personal data is added, unless it overlaps a base
span or a likelier one.

Two passes over the texts, none shuffled: the first counts vote patterns and
features (the counts of all documents, added up before the shuffle), the
second finds. Vote patterns are at most 81 for each kind; the classifier learns
from at most ``SAMPLE`` distinct feature rows, the first by a hash, each with
its count over all documents.

Places are code points, the end exclusive. Defined cases: a null or empty text
has no spans; texts are searched whole, in time linear in their length but for
the bounded surroundings of a candidate; rows that share an id each get their
own; a table without candidates of a kind adds none of it; an empty table gives
an empty result; other columns are not read by ``report`` and kept by ``redacted``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import pieces, with_columns_by_batch
from wardloom.sources.sinks import materialized

KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = 4
EMAIL, IP, CARD, PHONE, NAME = range(5)
LABELERS = ("form", "gazetteer", "context", "shape")
VOTES = (-1, 0, 1)
SAMPLE = 20_000
BUCKETS = 256
ROUNDS = 60
# Prior counts: how a labeler votes on spans of its kind and on others, before anything is seen.
PRIOR = np.array([[6.0, 3.0, 1.0], [1.0, 4.0, 5.0]])
PRIOR_SHARE = np.array([4.0, 1.0])
THRESHOLD = 0.5
BEFORE, AFTER = 48, 24

# --- fixed values --------------------------------------------------------------

DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu us ca au jp cn br in nl ch at".split())
ISSUERS = tuple("34 37 4 51 52 53 54 55 6011 65 2221 2720 3528 3589 30 36 38".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split())
GIVEN = frozenset(
    "Alice Anna Antonio Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma Francisco Hans Isabel James Jean "
    "Jennifer John Jose Juan Julia Karen Karl Laura Linda Louis Lucia Luis Manuel Margaret Maria Marie Mark Martin Mary Michael "
    "Miguel Monika Nancy Patricia Paul Peter Philippe Pierre Richard Robert Sandra Sarah Sophie Susan Thomas Ursula William Wolfgang".split()
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Don Doña".split())
CUES = (
    frozenset("email e-mail mail contact write address reach correo courriel".split()),
    frozenset("ip host server client from login address peer connected".split()),
    frozenset("card visa mastercard amex credit debit payment pay karte tarjeta carte".split()),
    frozenset("phone tel telephone call mobile cell fax dial sms whatsapp telefon teléfono téléphone".split()),
    frozenset("name named dear signed contact author by patient customer herr frau".split()),
)
AGAINST = (
    frozenset("example placeholder".split()),
    frozenset("version release v section build firmware".split()),
    frozenset("id order isbn serial token reference part sku".split()),
    frozenset("isbn order version serial id part page pages section total price".split()),
    frozenset("the in of at from to near and city street university company".split()),
)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = re.compile(r"@|\((?:at|AT)\)|\[(?:at|AT)\]|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)")
_LOOSE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?\Z")
_LOOSE_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\x20dot\x20|dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}+[0-9])*+")
_PAIR = re.compile(r"[A-ZÀ-Ý](?<!\w[A-ZÀ-Ý])[a-zß-ÿ]{1,15}\.? [A-ZÀ-Ý][a-zß-ÿ'-]{1,20}(?!\w)")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-. ])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-. ])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?![0-9])")
_WORD = re.compile(r"[\w'@-]+")

Span = tuple[int, int, int]  # kind, start, end


# --- base ----------------------------------------------------------------------


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the local part before an @ does: at its run's start, or where the match before ended."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of a dotted chain at a time; those that are no addresses are used up too."""
    for m in _DOTTED.finditer(text):
        if text.count(".", *m.span()) < 3:
            continue
        start, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = start + sum(map(len, own)) + 3
            if all(map(_byte, own)):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """Certain spans, by kind, then start."""
    out = [(EMAIL, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(IP, a, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(own := _digits(m.group())) <= 19 and luhn(own):
            out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- candidates, votes and features ----------------------------------------------


@dataclass
class Candidate:
    kind: int
    start: int
    end: int
    votes: tuple[int, ...] = ()
    features: tuple[int, ...] = ()


def _spelled(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _AT.finditer(text):
        local = _LOOSE_LOCAL.search(text, max(0, m.start() - 66), m.start())
        domain = _LOOSE_DOMAIN.match(text, m.end())
        if local and domain:
            yield EMAIL, local.start(), domain.end()


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if end - start < 7:
            continue
        if end - start > 64:
            continue  # no number of these kinds is so long; base spans in it stay
        own = m.group()
        n = len(_digits(own))
        if own.count(".") == 3 and n <= 12 and not set(own) - set("0123456789."):
            yield IP, start, end
        elif 13 <= n <= 19 and not set(own) - set("0123456789 -"):
            yield CARD, start, end
        elif 7 <= n <= 15:
            while start and text[start - 1] in "+(":
                start -= 1
            yield PHONE, start, end


def _shape(span: str) -> str:
    """Runs of digits, letters and capitals with their lengths up to 4."""
    classes = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span)
    return re.sub(r"9+|A+|a+", lambda m: f"{m.group()[0]}{min(len(m.group()), 4)}", classes)[:48]


def _vote(kind: int, span: str, certain: bool, before: list[str], opening: bool) -> tuple[int, ...]:
    digits = _digits(span)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    words = set(before)
    context = -1 if words & AGAINST[kind] else 1 if words & CUES[kind] else 0
    form, known, shape = 1 if certain else 0, 0, 0
    if kind == EMAIL:
        known = 1 if re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in DOMAINS else -1
        shape = -1 if re.search(r"\s[Aa][Tt]\s", span) and not re.search(r"\sdot\s", span) else 1 if len(span) <= 64 else 0
    elif kind == IP:
        form = 1 if certain else -1
        known = -1 if groups and (int(groups[0][:4]) in (0, 127, 255) or int(groups[0][:4]) >= 240) else 0
        shape = -1 if all(int(g[:4]) < 20 for g in groups) else 1
    elif kind == CARD:
        form = 1 if certain else -1
        known = 1 if digits.startswith(ISSUERS) else -1
        shape = -1 if len(set(digits)) < 4 else 1 if [len(g) for g in groups] == [4] * 4 else 0
    elif kind == PHONE:
        known = 1 if span.startswith("+") and digits.startswith(CALLING) else 0
        sizes = [len(g) for g in groups]
        shape = -1 if _DATE.match(span) or len(groups) == 1 or len(groups) > 6 or len(set(digits)) < 3 else 1 if sizes[-1] == 4 and sizes[-2] == 3 else 0
    else:
        first, second = span.replace(".", "").split(" ", 1)
        form = 1 if first in TITLES else 0
        known = 1 if first in GIVEN or second in GIVEN else -1 if first not in TITLES else 0
        shape = -1 if opening or first == second else 1 if first in GIVEN or first in TITLES else 0
    return form, known, context, shape


def _features(kind: int, span: str, certain: bool, before: list[str], after: list[str], opening: bool) -> tuple[int, ...]:
    digits = _digits(span)
    named = [f"shape {_shape(span)}", f"digits {len(digits)}", f"open {opening}"]
    named += [f"before {w}" for w in before] + [f"after {w}" for w in after]
    if kind == EMAIL:
        named.append(f"domain {re.split(r'[^A-Za-z0-9-]+', span)[-1].lower()}")
    elif kind == NAME:
        first, second = span.replace(".", "").split(" ", 1)
        named += [f"title {first in TITLES}", f"given {first in GIVEN} {second in GIVEN}", f"same {first == second}"]
    else:
        named += [f"start {span[:1] if not span[:1].isdigit() else digits[:1]}", f"variety {len(set(digits)) > 3}"]
    # what decides most has places of its own, the rest shares the others by hash
    own = {0: certain, 1: kind in (CARD, PHONE) and luhn(digits), 2: not certain}
    return tuple(sorted({i for i, holds in own.items() if holds} | {len(own) + zlib.crc32(f.encode()) % (BUCKETS - len(own)) for f in named}))


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """All candidates of a text, base spans among them, with votes and features."""
    certain = set(base)
    taken = set(base)
    if "@" in text or "at" in text or "AT" in text:
        taken.update(_spelled(text))
    taken.update(_numbers(text))
    taken.update((NAME, *m.span()) for m in _PAIR.finditer(text))
    out = []
    for kind, start, end in sorted(taken):
        if end - start > 200:
            continue  # base spans of any length stay, but say nothing about others
        span = text[start:end]
        lead = text[max(0, start - BEFORE) : start]
        before = [w.lower() for w in _WORD.findall(lead)[-3:]]
        after = [w.lower() for w in _WORD.findall(text[end : end + AFTER])[:1]]
        opening = not lead.strip() or lead.rstrip(" ")[-1:] in ".!?\n:"
        sure = (kind, start, end) in certain
        out.append(Candidate(kind, start, end, _vote(kind, span, sure, before, opening), _features(kind, span, sure, before, after, opening)))
    return out


# --- model ---------------------------------------------------------------------


@dataclass
class LabelModel:
    """For each kind, the share of true spans and the chance of each vote of each labeler on other and on true spans."""

    share: np.ndarray
    chance: np.ndarray  # kind x labeler x truth x vote

    def probability(self, kind: int, votes: tuple[int, ...]) -> float:
        logs = np.log(np.array([1 - self.share[kind], self.share[kind]]))
        for j, v in enumerate(votes):
            logs = logs + np.log(self.chance[kind, j, :, v + 1])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))


def estimate(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over the counts of (kind, votes)."""
    kinds, labelers = len(KINDS), len(LABELERS)
    model = LabelModel(np.full(kinds, PRIOR_SHARE[1] / PRIOR_SHARE.sum()), np.tile(PRIOR / PRIOR.sum(axis=1, keepdims=True), (kinds, labelers, 1, 1)))
    listed = sorted(counts.items())
    for _ in range(rounds):
        share, chance = np.tile(PRIOR_SHARE, (kinds, 1)), np.tile(PRIOR, (kinds, labelers, 1, 1))
        for (kind, votes), n in listed:
            # what the fixed pattern of a kind finds is true by definition
            p = 1.0 if kind < BASE_KINDS and votes[0] == 1 else model.probability(kind, votes)
            share[kind] += n * np.array([1 - p, p])
            for j, v in enumerate(votes):
                chance[kind, j, :, v + 1] += n * np.array([1 - p, p])
        model = LabelModel(share[:, 1] / share.sum(axis=1), _no_worse_than_chance(chance))
    return model


def _no_worse_than_chance(counts: np.ndarray) -> np.ndarray:
    """Vote chances; a labeler that seems to say yes oftener, or no rarer, on other spans than on true ones is taken to tell nothing.

    Without that the classes could change places, or mean something else than the labelers do.
    """
    chance = counts / counts.sum(axis=3, keepdims=True)
    pooled = counts.sum(axis=2, keepdims=True)
    pooled = np.broadcast_to(pooled / pooled.sum(axis=3, keepdims=True), chance.shape)
    wrong = (chance[:, :, 1, 2] < chance[:, :, 0, 2]) | (chance[:, :, 1, 0] > chance[:, :, 0, 0])
    return np.where(wrong[:, :, None, None], pooled, chance)


def train(features: list[tuple[int, ...]], truth: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the constant comes last."""
    x = np.zeros((len(features), BUCKETS + 1))
    x[:, -1] = 1
    for i, own in enumerate(features):
        x[i, list(own)] = 1
    w = np.zeros(BUCKETS + 1)
    ridge = np.diag([1.0] * BUCKETS + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - truth)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def score(self, c: Candidate) -> float:
        w = self.weights.get(c.kind)
        if w is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(w[list(c.features)].sum() + w[-1], -40, 40))))

    def added(self, text: str, base: list[Span]) -> list[tuple[int, int, int, float]]:
        """The likeliest candidates that overlap neither a base span nor one another."""
        if not self.weights:
            return []
        certain = set(base)
        likely = [(self.score(c), c) for c in candidates(text, base) if (c.kind, c.start, c.end) not in certain]
        taken = Taken(base)
        out = []
        for score, c in sorted(((s, c) for s, c in likely if s >= THRESHOLD), key=lambda p: (-p[0], p[1].start, p[1].kind)):
            if taken.add(c.start, c.end):
                out.append((c.kind, c.start, c.end, score))
        return sorted(out)


class Taken:
    """Places of a text that are spoken for, as disjoint ranges in order."""

    def __init__(self, base: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(base, key=lambda s: s[1:]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def add(self, start: int, end: int) -> bool:
        """Take a range, if none of it is taken."""
        i = bisect.bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


_COUNTED = "kind int, votes array<int>, features array<int>, n long"


def _counted(docs: DataFrame) -> DataFrame:
    """kind, votes, features of the candidates of all texts, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found: Counter = Counter()
                for text in piece.column("text").to_pylist():
                    if text:
                        found.update((c.kind, c.votes, c.features) for c in candidates(text, base_spans(text)))
                keys = list(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.list_(pa.int32())),
                    pa.array([k[2] for k in keys], pa.list_(pa.int32())), pa.array([found[k] for k in keys], pa.int64()),
                ], names=["kind", "votes", "features", "n"])

    return docs.select("text").mapInArrow(run, _COUNTED).groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Reliabilities of the labelers over all texts, and a span classifier for each kind that has candidates."""
    counted = materialized(_counted(docs), "pii-candidates")
    patterns = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # at most 81 for each kind
    labels = estimate({(r["kind"], tuple(r["votes"])): r["n"] for r in patterns})
    model = Model(labels)
    first = _first_by_hash(counted, sample)
    for kind in range(len(KINDS)):
        own = [r for r in first if r["kind"] == kind]
        if own:
            truth = np.array([labels.probability(kind, tuple(r["votes"])) for r in own])
            # copies say the same again, so a row's weight grows with its logarithm only
            weight = 1 + np.log(np.array([r["n"] for r in own], np.float64))
            model.weights[kind] = train([tuple(r["features"]) for r in own], truth, weight)
    return model


def _first_by_hash(counted: DataFrame, rows: int) -> list:
    """The first ``rows`` by a hash; of more, only about twice as many leave the tasks to be ordered."""
    n = counted.count()
    order = F.xxhash64("kind", "votes", "features")
    some = counted if n <= rows else counted.where(order < F.lit(int(2.0**64 * min(1.0, 2 * rows / n)) - 2**63 if 2 * rows < n else 2**63 - 1))
    return some.orderBy(order, "kind", "votes", "features").limit(rows).collect()


def reliabilities(model: Model) -> list[dict]:
    """What was learned of each labeler: how often it votes yes on true and on other spans."""
    return [
        {"kind": KINDS[k], "labeler": name, "yes_on_true": float(model.labels.chance[k, j, 1, 2]), "yes_on_other": float(model.labels.chance[k, j, 0, 2])}
        for k in range(len(KINDS)) for j, name in enumerate(LABELERS)
    ]


_SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())
])
_SPANS = T.StructType([T.StructField("base", T.ArrayType(_SPAN)), T.StructField("added", T.ArrayType(_SPAN))])


def spans(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with arrays ``base`` and ``added`` of (kind, start, end, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        base, added = [], []
        for text in column.to_pylist():
            own = base_spans(text) if text else []
            base.append([{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for k, a, b in own])
            more = shared.value.added(text, own) if text else []
            added.append([{"kind": KINDS[k], "start": a, "end": b, "score": s} for k, a, b, s in more])
        return [base, added]

    return with_columns_by_batch(docs, "text", _SPANS, compute, keep)


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span of a text replaced by its kind in angle brackets; overlapping base spans by the first one's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        own = base_spans(text)
        out, at = [], 0
        for start, end, kind in sorted([(a, b, k) for k, a, b in own] + [(a, b, k) for k, a, b, _ in shared.value.added(text, own)]):
            if start >= at:
                out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    def cleaned(column: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in column.to_pylist()], pa.string())

    return docs.withColumn("text", cleaned(F.col("text")))


def _listed(own: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(own))


_REPORT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE_KINDS]]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and their digest, and all spans of every document."""
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        rows = []
        for text in column.to_pylist():
            own = base_spans(text) if text else []
            more = shared.value.added(text, own) if text else []
            counts = Counter(k for k, _, _ in own)
            digest = hashlib.sha256(_listed(own).encode()).hexdigest()
            rows.append([*(counts[k] for k in range(BASE_KINDS)), digest, _listed(own + [s[:3] for s in more]), len(more)])
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in _REPORT]

    return with_columns_by_batch(docs.select("doc_id", "text"), "text", _REPORT, compute, ["doc_id"])
