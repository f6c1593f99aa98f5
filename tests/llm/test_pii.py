import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardloom.llm import pii
from wardloom.llm.common import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v // 10 + v % 10
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and passes_luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def listed(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


PIECES = ["a", "Z9", "@", ".", "+", "-", " ", "(", ")", "1", "255", "256", "4111111111111111", "4111 1111 1111 1111", "x@y.de", "\n", "é", "😀", "+1 (017) 555-7713",
          "1.2.3.4", "0007", "%", "_", "at", " dot "]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_is_the_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "+1" + " " * 400_000, "1.2." * 100_000, "a@b." * 100_000, "Ab " * 150_000, "1 " * 200_000, "+1 (" * 100_000, "x@y.com 1.2.3.4 " * 20_000):
        pii.Model(pii.estimate({}), {0: np.zeros(pii.BUCKETS + 1)}).added(text, pii.base_spans(text))


def check(df, docs):
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [g["doc_id"] for g in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    text = dict(docs)
    for g in got:
        base = brute(text[g["doc_id"]])
        assert [g[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[0] == k for b in base) for k in pii.KINDS[:4]]
        assert g["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        spans = [s.split(":") for s in g["spans"].split(",")] if g["spans"] else []
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert set(base) <= set(spans) and len(spans) == len(base) + g["n_added"]
        extra = [s for s in spans if s not in set(base)]
        for k, a, b in extra:
            assert not any(x[1] < b and a < x[2] for x in spans if x != (k, a, b))
    return {g["doc_id"]: g for g in got}


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    got = check(pii.report(docs), [(r.doc_id, r.text) for r in docs.collect()])
    # invented prose without personal data is left alone
    assert sum(g["n_added"] > 0 for g in got.values()) <= 0.02 * len(got)


def corpus():
    rng = np.random.default_rng(2)
    number = lambda n: "".join(rng.choice(list("0123456789"), n))
    out = []
    for i in range(400):
        out.append((i, [
            f"please call +1 ({number(3)}) {number(3)}-{number(4)} or mail user{i}@site.org soon",
            f"the phone is ({number(3)}) {number(3)}-{number(4)} at home",
            f"signed by Dr. Maria Lopez on the day",
            f"order id {number(16)} was shipped with version {i % 9}.{i % 7}.{i % 5}.{i % 3}",
            f"nothing here but Some Words about a {number(3)} ride",
        ][i % 5]))
    return out


def test_added_spans(spark, rows):
    docs = corpus()
    frame = rows(docs, "doc_id long, text string")
    got = check(pii.report(frame), docs)
    text = dict(docs)
    found = lambda i: [s.split(":") for s in got[i]["spans"].split(",") if s]
    phones = [i for i in text if i % 5 == 1]
    caught = [i for i in phones if any(k == "phone" and text[i][int(a) : int(b)].startswith("(") for k, a, b in found(i))]
    assert len(caught) >= 0.9 * len(phones)
    names = [i for i in text if i % 5 == 2]
    assert sum(any(k == "name" for k, _, _ in found(i)) for i in names) >= 0.9 * len(names)
    assert not any(True for i in text if i % 5 == 3 for k, a, b in found(i) if k == "card" and not passes_luhn(text[i][int(a) : int(b)]))
    assert not any(found(i) for i in text if i % 5 == 4)
    clean = pii.redacted(frame.withColumn("Score", frame.doc_id), pii.fit(frame))
    assert clean.columns == ["doc_id", "text", "Score"]
    first = clean.where("doc_id = 0").first().text
    assert first == "please call <PHONE> or mail <EMAIL> soon"


def test_reliabilities_are_found():
    """Votes drawn from known labelers: EM gives back their reliabilities."""
    rng = np.random.default_rng(4)
    chance = np.array([[[0.8, 0.15, 0.05], [0.05, 0.15, 0.8]], [[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]], [[0.1, 0.8, 0.1], [0.05, 0.5, 0.45]], [[0.6, 0.3, 0.1], [0.2, 0.2, 0.6]]])
    counts = {}
    for _ in range(40_000):
        y = int(rng.random() < 0.3)
        votes = tuple(int(rng.choice([-1, 0, 1], p=chance[j, y])) for j in range(4))
        counts[pii.NAME, votes] = counts.get((pii.NAME, votes), 0) + 1
    model = pii.estimate(counts, rounds=200)
    assert model.share[pii.NAME] == pytest.approx(0.3, abs=0.03)
    assert model.chance[pii.NAME] == pytest.approx(chance, abs=0.05)


def test_cases(spark, rows):
    card = "4111 1111 1111 1111"
    docs = [(1, None), (2, ""), (3, f"{card} and {card}"), (None, "a@b.co"), (5, "x " * 300_000 + "1.2.3.4"), (6, "1" * 5000), (7, "+1 (017) 555-7713")]
    got = check(pii.report(rows([(d, t, 1, "s") for d, t in docs], "doc_id int, text string, n_email int, Spans string")), docs)
    assert got[3]["n_card"] == 2 and got[5]["n_ip"] == 1
    twice = rows([(4, "a@b.co"), (4, "none")], "doc_id long, text string")
    assert sorted(r.n_email for r in pii.report(twice).collect()) == [0, 1]
    assert pii.report(rows([], "doc_id long, text string")).count() == 0
    assert pii.redacted(rows([(1, None), (2, "")], "doc_id long, text string"), pii.fit(twice)).select("text").collect()[0].text is None
