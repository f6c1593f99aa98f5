import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from wardloom.llm import mixing, quality_rules as qr
from wardloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xx(*longs_or_text):
    """Spark's xxhash64: the hash so far is the next seed."""
    seed = 42
    for x in longs_or_text:
        data = x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, x in enumerate(windows) if x in twice for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def grams(text):
    h = [xx(w) for w in WORD.findall(text or "")]
    return [x % qr.BUCKETS for x in h] + [xx(a, b) % qr.BUCKETS for a, b in zip(h, h[1:])]


def brute_rules(docs, good, loss=qr.LOSS):
    raw, own = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in good:
            own.update(grams(t))
    r, o = sum(raw.values()), sum(own.values())
    ratio = {b: round(math.log((own[b] + n * (qr.BUCKETS / max(r, 1))) / (o + qr.BUCKETS) / (n / max(r, 1))) * qr.SCALE) for b, n in raw.items()}
    rows = []
    for d, t in docs:
        g = grams(t)
        mean = sum(ratio[b] for b in g) / (len(g) * qr.SCALE) if g else 0.0
        rows.append((d, base(t), mean, math.floor(mean * qr.STEPS)))
    steps = sorted(s for d, _, _, s in rows if d in good)
    least = next((s for s in sorted(set(steps)) if sum(x <= s for x in steps) > loss * len(steps)), qr.LOWEST)
    out = []
    for d, b, mean, step in rows:
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        out.append((d, *b, failed, not failed and step >= least, mean))
    return sorted(out, key=repr)


def check_rules(df, expected):
    got = sorted((tuple(r[c] for c in ("doc_id", *qr.BASE, "base_failed", "kept", "score")) for r in df.collect()), key=repr)
    assert [g[:8] for g in got] == [e[:8] for e in expected]
    assert [g[8] for g in got] == pytest.approx([e[8] for e in expected], abs=1e-6)


def test_rules_cases(spark, rows):
    phrase = "one two three four five six seven eight"
    docs = [(1, None), (2, ""), (3, " \t\x0b\x0c\r\n "), (4, f"{phrase} {phrase} nine"), (5, "a " * 100), (6, "l1\nl1\n\n \nl1\nL1 | # é€😀"),
            (7, f"x {phrase} y " + " ".join(f"w{i}" for i in range(40)) + f" {phrase}"), (8, "w " * 30000), (9, "nbsp is a word char"),
            (10, " ".join(f"good{i % 9}" for i in range(60))), (10, " ".join(f"good{i % 9}" for i in range(60))), (None, "good1 good2")]
    labels = rows([(10, 1, 0), (10, 1, 0), (7, 1, 0), (5, 0, 0), (None, 1, 0), (4, None, None)], "doc_id int, quality int, toxic int")
    check_rules(qr.report(rows(docs, "doc_id long, text string"), labels), brute_rules(docs, {10, 7}))


def test_rules_table(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    check_rules(qr.report(docs, labels), brute_rules([(r.doc_id, r.text) for r in docs.collect()], good))


def test_rules_empty(spark, rows):
    none = rows([], "doc_id long, quality int, toxic int")
    assert qr.report(rows([], "doc_id long, text string"), none).count() == 0
    assert qr.report(rows([(1, "a b " * 3 + "c d e f g h i j k l m n o p q r s t u v")], "doc_id long, text string"), none).first().kept


def brute_mix(docs, labelled, weights, kept, max_rate):
    count = [Counter() for _ in weights]
    bucket = lambda w: xx(w) % mixing.BUCKETS
    seen = Counter(labelled.values())
    for d, t in docs:
        if d in labelled:
            count[labelled[d]].update(map(bucket, WORD.findall(t or "")))
    total = [sum(c.values()) for c in count]
    p, tokens = [], []
    for _, t in docs:
        w = WORD.findall(t or "")
        n = max(len(w), 1)
        v = np.array([
            math.log((seen[k] + 1) / (len(labelled) + len(weights)))
            + sum(math.log((count[k][bucket(x)] + 1) / (total[k] + mixing.BUCKETS)) for x in w) / n * min(n, mixing.VOICE)
            for k in range(len(weights))
        ])
        e = np.exp(v - v.max())
        p.append(e / e.sum())
        tokens.append(len(w))
    a = np.array(p) * np.array(tokens)[:, None]
    y = a.sum(axis=0)
    t = y[kept] * np.array(weights) / weights[kept]
    t = np.clip(t, 0, np.inf if max_rate is None else max_rate * y)
    top = np.inf if max_rate is None else max_rate
    inverse = np.linalg.pinv(a.T @ a, rcond=1e-12, hermitian=True)
    squares = lambda y: (y - t) @ inverse @ (y - t) / 2
    r = np.ones(len(a))
    for _ in range(mixing.STEPS):
        y = r @ a
        if np.abs(y - t).max() <= mixing.TOLERANCE * np.abs(t).max():
            break
        slope = inverse @ (y - t)
        free = a[~((r <= 0) & (a @ slope > 0)) & ~((r >= top) & (a @ slope < 0))]
        after = np.clip(r - a @ (np.linalg.pinv(free.T @ free, rcond=1e-10, hermitian=True) @ (y - t)), 0, top)
        if squares(after @ a) > squares(y):
            after = np.clip(r - a @ slope, 0, top)
        r = after
        if squares(y) - squares(r @ a) <= mixing.STANDSTILL * squares(y):
            break
    return np.array(p), r, r @ a, t


def test_squares_are_least(spark, folder):
    """Hundreds of plain steps more lower the squares by under a ten-thousandth of what they were at first.

    Where targets cannot be reached together, documents near the edge of what pays move ever more slowly.
    """
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found, mix = mixing.fitted(docs, labels, (0.94, 0.05, 0.01), 0, 1.0)
    rows = found.collect()
    a = np.array([[x.p0, x.p1, x.p2] for x in rows]) * np.array([x.tokens for x in rows])[:, None]
    r = np.array([x.rate for x in rows])
    inverse = np.linalg.pinv(a.T @ a, rcond=1e-12, hermitian=True)
    t = np.array(mix.target)
    squares = lambda y: (y - t) @ inverse @ (y - t) / 2
    slope = a @ (inverse @ (r @ a - t))
    plain = np.clip(r - slope, 0, 1)
    for _ in range(300):
        plain = np.clip(plain - a @ (inverse @ (plain @ a - t)), 0, 1)
    assert squares(plain @ a) <= squares(r @ a) <= squares(plain @ a) + 1e-4 * squares(a.sum(axis=0))


@pytest.mark.parametrize("max_rate", [None, 1.0])
def test_mixing_against_numpy(spark, folder, max_rate):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = {r.doc_id: 2 if r.toxic == 1 else 1 if r.quality == 0 else 0 for r in labels.collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    weights = (0.8, 0.15, 0.05)
    p, r, reached, targets = brute_mix(rows, known, weights, 0, max_rate)
    got = mixing.mixed(docs, labels, weights, 0, max_rate).orderBy("doc_id").collect()
    assert [[x.p0, x.p1, x.p2] for x in got] == pytest.approx(p, abs=1e-4)
    assert [x.rate for x in got] == pytest.approx(r, abs=1e-3)
    totals = [sum(x.rate * x.tokens * x[f"p{d}"] for x in got) for d in range(3)]
    assert totals == pytest.approx(list(reached), rel=1e-5)
    assert totals == pytest.approx([got[0][f"reached{d}"] for d in range(3)], rel=1e-9)
    assert [got[0][f"target{d}"] for d in range(3)] == pytest.approx(list(targets), rel=1e-4)
    if max_rate is None:
        assert totals == pytest.approx(list(targets), rel=1e-4)


def test_mixing_holds_the_kept_domain(spark, folder):
    """Documents that are likeliest clean stay; what is wanted of the others is brought into reach and reached."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found, mix = mixing.fitted(docs, labels, (0.94, 0.05, 0.01), 0, 1.0, hold=True)
    rows = found.collect()
    assert all(r.held == (r.p0 >= max(r.p1, r.p2)) and (not r.held or r.rate == 1.0) for r in rows)
    reached = [sum(r.rate * r.tokens * r[f"p{d}"] for r in rows) for d in range(3)]
    assert reached == pytest.approx(mix.reached, rel=1e-9)
    assert mix.reached[0] >= 0.99 * mix.had[0]
    least = [sum(r.tokens * r[f"p{d}"] for r in rows if r.held) for d in range(3)]
    assert all(a - 1e-6 <= t <= h + 1e-6 for a, t, h in zip(least, mix.target, mix.had))
    summary = {r.domain: r for r in mixing.summary(spark, mix).collect()}
    assert summary["toxic"].target == mix.target[2] and summary["clean"].had == mix.had[0]


def test_labels_of_absent_documents_count_for_nothing(spark, rows):
    docs = rows([(1, "good words here"), (2, "bad words there")], "doc_id long, text string")
    known = [(1, 1, 0), (2, 1, 1)]
    kind = "doc_id int, quality int, toxic int"
    plain = mixing.mixed(docs, rows(known, kind), (0.9, 0.05, 0.05)).orderBy("doc_id").collect()
    more = rows(known + [(i, 1, 1) for i in range(10, 400)], kind)
    assert mixing.mixed(docs, more, (0.9, 0.05, 0.05)).orderBy("doc_id").collect() == plain


def test_mixing_cases(spark, rows):
    docs = rows([(1, None, 1), (2, "", 2), (3, "good words " * 30, 3), (4, "bad words " * 30, 4), (4, "bad words " * 30, 4), (None, "good", 5), (5, "w " * 20000, 6)],
                "doc_id int, text string, copies int")
    labels = rows([(3, 1, 0), (3, 1, 0), (4, 1, 1), (None, 1, 1), (9, None, None)], "doc_id int, quality int, toxic int")
    got = mixing.mixed(docs, labels, (0.9, 0.09, 0.01))
    assert got.count() == 7
    assert all(r.rate >= 0 and abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in got.collect())
    out = mixing.sampled(docs, labels, (0.9, 0.09, 0.01))
    assert out.columns == docs.columns
    assert {1, 2, 3}.issubset({r.doc_id for r in out.collect()})
    none = rows([], "doc_id int, quality int, toxic int")
    assert mixing.mixed(docs.limit(0), labels, (0.5, 0.5, 0.5)).count() == 0
    assert mixing.sampled(docs, none, (0.5, 0.25, 0.25)).columns == docs.columns


def test_every_trusted_document_counts(spark, rows):
    """More trusted documents than any bounded sample took: the counts are those of all of them."""
    n = 20_500
    docs = [(i, f"w{i % 7} w{i % 11} x{i % 3}") for i in range(n)] + [(n, "other words here")]
    good = set(range(n))
    labels = rows([(i, 1) for i in good] + [(n, 0), (None, 1)], "doc_id long, quality int")
    found = qr.log_ratios(rows(docs, "doc_id long, text string"), labels.where("quality = 1 and doc_id is not null").select("doc_id"))
    kept = []
    log_ratios = qr.log_ratios

    def seen(d, trusted):
        kept.append(trusted.count())
        return log_ratios(d, trusted)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(qr, "log_ratios", seen)
        got = qr.report(rows(docs, "doc_id long, text string"), labels)
    assert kept == [n] and got.count() == n + 1 and found.count() > 0


def test_trusted_ids_too_many_to_broadcast(spark, rows, folder):
    """The join by id gives what the broadcast gives."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    before = sorted(qr.report(docs, labels).collect(), key=repr)
    limits = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(qr.report(docs, labels).collect(), key=repr) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for k, v in limits.items():
            spark.conf.set(k, v)


def test_runs_of_hashes_are_not_copied_for_each_place(spark, rows):
    texts = [None, "a", "a b", "a b c d e f g h i", " ".join("a b c d e f g h".split() * 3)]
    docs = rows(list(enumerate(texts)), "doc_id long, text string")
    hashed = qr._hashed(qr._texts(docs))
    found = qr.with_base(hashed).select("doc_id", *qr.BASE, qr._grams().alias("grams"))
    assert "slice(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: (tuple(r[1:6]), r["grams"]) for r in found.collect()}
    for i, text in enumerate(texts):
        n, chars, symbols, lines, repeats = base(text)
        assert got[i] == ((n, chars, symbols, lines, repeats), grams(text))
