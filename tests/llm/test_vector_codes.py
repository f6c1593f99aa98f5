import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from wardloom.llm import vector_codes as vc
from wardloom.llm.common import table


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) of one length; {place: (code, error, label_error)} and the digest."""
    x = [[math.floor(1024 * float(c)) for c in v] for _, v, _ in rows]
    width = -(-len(x[0]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def assign(p):
        c = np.array(books[p], np.int64)
        out = []
        for v in cut:
            d = ((c - np.array(v[p], np.int64)) ** 2).sum(axis=1)
            out.append((int(d.argmin()), int(d.min())))
        return out

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v, (e, _) in zip(cut, assign(p)):
                members[e].append(v[p])
            for e, own in members.items():
                books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    last = [assign(p) for p in range(parts)]
    error = [sum(last[p][i][1] for p in range(parts)) for i in range(len(rows))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(rows, error):
        by_label[label] += e
    numbers = [str(n) for book in books for entry in book for n in entry]
    codes = ["".join(f"{last[p][i][0]:02x}" for p in range(parts)) for i in range(len(rows))]
    return sorted(((r[0], codes[i], error[i], by_label[r[2]]) for i, r in enumerate(rows)), key=repr), hashlib.sha256(",".join(numbers).encode()).hexdigest()


def check(df, rows):
    expected, digest = brute(rows)
    got = df.collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == expected
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_table(spark, folder):
    source = table(spark, folder, "embeddings")
    check(vc.report(source), [(r.vec_id, r.embedding, r.label) for r in source.collect()])


@pytest.mark.parametrize("large", [1.0, 30_000.0])
def test_cases(spark, rows, large):
    rng = np.random.default_rng(3)
    many = [(i, (rng.normal(size=10) * rng.choice([0.02, 1.0])).astype("float32").tolist(), int(i) % 3) for i in range(400)]
    many += [(1000 + i, many[7][1], None) for i in range(300)]  # a third of all rows are one vector
    many += [(5, many[9][1], 1), (None, [large] * 10, None)]
    bad = [(-5, None, 1), (-4, [None] * 10, 1), (-3, [float("nan")] * 10, 1), (-2, [float("inf")] * 10, 1)]
    kind = "vec_id long, embedding array<float>, label int, Code int, x int"
    df = rows([(*r, 1, 1) for r in many + bad], kind)
    if large > 20_000:
        many[-1] = (None, [2.0**24 / 1024] * 10, None)
    check(vc.report(df), many)


def test_other_lengths_and_empty(spark, rows):
    kind = "vec_id long, embedding array<double>, label string"
    few = [(3, [0.5, 1.0, -0.25, 0.1], "a"), (1, [0.5, 1.0, -0.25, 0.2], None), (2, [-1e-9, 0.0, 0.0, 0.0], None)]
    check(vc.report(rows(few, kind)), few)
    odd = vc.report(rows([*few, (9, [1.0], None), (8, [], "a")], kind))
    assert {(r.vec_id, r.code, r.error) for r in odd.collect() if r.vec_id > 7} == {(8, None, None), (9, None, None)}
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in odd.collect() if r.vec_id < 8} == set(brute(few)[0])
    assert vc.report(rows([], kind)).count() == 0
    assert vc.report(rows([(1, None, "a"), (2, [None], "b")], kind)).count() == 0
    assert [r.code for r in vc.report(rows([(1, [], "a")], kind)).collect()] == [None]


def test_nothing_moves_but_what_changes(spark, rows, monkeypatch):
    """After the first settling only members whose entry changed are shuffled."""
    rng = np.random.default_rng(1)
    df = rows([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, x array<double>")
    whole = df.selectExpr("vec_id", "transform(x, e -> cast(floor(e * 1024) as bigint)) as x")
    seen, settle = [], vc._settle

    def watched(members, location):
        folders = settle(members, location)
        all_, came = (spark.read.parquet(f) for f in folders)
        seen.append((all_.count(), all_.where("moved = 'true'").count(), came.count()))
        return folders

    monkeypatch.setattr(vc, "_settle", watched)
    vc.fit(whole, entries=16)
    assert seen[0] == (1200, 1200, 1200)
    assert len(seen) == 4 and all(n == 1200 and moved == came < 600 for n, moved, came in seen[1:])
