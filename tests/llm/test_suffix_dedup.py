import hashlib

import numpy as np
import pytest

from wardloom.llm import suffix_dedup as sd
from wardloom.llm.common import table


def brute(docs):
    texts = sorted({(-(1 << 63) if d is None else d): (t or "").encode() for d, t in docs}.items())
    first, results = {}, {}
    for doc, text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            string = text[i : i + 100]
            if string in first:
                gone[i : i + 100] = True
            else:
                first[string] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        results[doc] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((d, *results[-(1 << 63) if d is None else d]) for d, _ in docs), key=repr)


def ours(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases():
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, other = word(300), word(99)
    long = word(20_000)
    docs = [(1, None), (2, ""), (3, "short"), (4, passage), (5, word(50) + passage + word(70)), (6, passage[:180] + "X" + passage[180:]),
            (7, other + "é" + other), (8, "a" * 1000), (9, "ab" * 400 + "a" * 300), (10, long), (11, long[5000:15_000] + long[2000:9000]),
            (12, word(60) + passage[100:199]), (13, word(60) + passage[100:200] + "!"), (None, passage), (14, other + other), (15, word(10) + long[:100]), (15, None)][:-1]
    docs += [(100 + i, word(30) + passage[i : 150 + i] + word(30)) for i in range(60)]
    docs += [(200, passage), (200, passage)]
    return docs


@pytest.mark.parametrize("many", [2000, 3])
def test_against_brute_force(spark, rows, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY", many)
    docs = cases()
    assert ours(sd.deduplicated(rows(docs, "doc_id long, text string"))) == brute(docs)


def test_long_groups_pass_in_small_batches(spark, rows, monkeypatch):
    """A common phrase in ever new surroundings, its records met a few at a time by one task."""
    monkeypatch.setattr(sd, "MANY", 3)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    phrase, around = word(64), [word(90) for _ in range(12)]
    docs = [(i, around[rng.integers(12)] + phrase + around[rng.integers(12)] + word(20)) for i in range(150)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = ours(sd.deduplicated(rows(docs, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == brute(docs)


def test_table_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    assert ours(sd.deduplicated(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_kept_bytes_and_empty_table(spark, rows):
    docs = rows([(1, "x" * 150), (2, "é" * 60)], "doc_id int, text string")
    kept = {r.doc_id: r.kept_text for r in sd.deduplicated(docs, texts=True).collect()}
    assert kept == {1: b"x", 2: "é".encode()[:2]}
    assert sd.deduplicated(rows([], "doc_id long, text string")).count() == 0


def test_mergesort_and_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(300)]
    sizes = np.array([len(t) for t in texts])
    group = rng.integers(0, 5, 300)
    order = sd.Suffixes(sd.Hashed(b"".join(texts)), np.cumsum(sizes) - sizes, sizes, group).sorted()
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))
    # with a hash that always collides, verification still finds the truth
    monkeypatch.setattr(sd, "_mixed", lambda x: x * np.uint64(0))
    a, b = b"q" * 100, b"q" * 99 + b"r"
    flat = np.zeros(4, np.int64)
    got = sd.repeated_starts(flat, np.array([1, 2, 3, 4]), flat, flat + 1, flat, [a, b, a, b])
    assert sorted(got[0].tolist()) == [3, 4]


@pytest.mark.parametrize("many", [2000, 3])
def test_rows_of_one_id_with_other_texts(spark, rows, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY", many)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    same, own = word(150), [word(400) for _ in range(8)]
    # the passage starts at the same place in two texts of an id, and in others elsewhere
    texts = [same + own[0], same + own[1], own[2][:200] + same + own[2][200:], own[3], own[4] + own[4]]
    for doc in (None, 7):
        docs = [(doc, t) for t in texts] + [(doc, texts[1]), (9, own[5] + same), (10, own[6]), (-(1 << 63), own[7] + own[3])]
        got = sorted((tuple(r) for r in sd.deduplicated(rows(docs, "doc_id long, text string")).collect()), key=repr)
        # by a single key for each text, in the order that the module says
        digest = {r.text: r.h for r in rows(docs, "doc_id long, text string").selectExpr("text", "xxhash64(text) h").collect()}
        order = lambda d, t: (d is not None, d or 0, digest[t] % (1 << 63) if d == doc else 0)
        number = {k: i for i, k in enumerate(sorted(set(docs), key=lambda x: order(*x)))}
        expected = {n: r for n, *r in brute([(number[k], k[1]) for k in docs])}
        assert got == sorted(((k[0], *expected[number[k]]) for k in docs), key=repr)
