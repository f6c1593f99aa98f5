import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from wardloom.llm import katz
from wardloom.llm.common import release, table


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute(docs, share):
    train = [tokens(t) for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    least = max(2, math.ceil(n * share))
    common = {w for w, k in c.items() if k >= least} | {None}
    cls = lambda w: w if w in common else "rare"
    ids = [*common, "rare"]
    one = {w: c.get(w, 0) for w in common}
    one["rare"] = n - sum(one.values())
    p1 = {w: (one[w] + 0.5) / (n + 0.5 * len(ids)) for w in ids}
    two = Counter()
    for t in train:
        own = [None, *map(cls, t)]
        two.update(zip(own, own[1:]))
    d = dict(enumerate(katz.good_turing(Counter(two.values())), 1))
    after = {}
    for (h, w), k in two.items():
        after.setdefault(h, {})[w] = k
    rare_n, rare_v = one["rare"], sum(w not in common for w in c)

    def p(w, h):
        own = after.get(h, {})
        disc = {x: d.get(k, 1.0) * k for x, k in own.items()}
        if len(own) == len(ids):
            return disc[w] / sum(disc.values())
        whole = sum(own.values()) + (1 if own and all(k > 5 for k in own.values()) else 0)
        if w in own:
            return disc[w] / whole
        left = 1 - sum(disc.values()) / whole if own else 1
        return left / (1 - sum(p1[x] for x in own)) * p1[w]

    for h in ids:
        assert sum(p(w, h) for w in ids) == pytest.approx(1)
    out = []
    for doc, text in docs:
        t = tokens(text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        own = [None, *map(cls, t)]
        score = sum(math.log10(p(w, h)) for h, w in zip(own, own[1:]))
        score += sum(math.log10((c[w] + 0.5) / (rare_n + 0.5 * (rare_v + 1))) for w in t if w not in common)
        held = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
        out.append((doc, held, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out, key=repr)


def same(df, expected):
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in df.collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_small(spark, rows):
    docs = [(i, "The cat sat on the mat the cat " + f"w{i % 7} " * (i % 5) + f"only{i}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, "zzz unseen words é"), (103, "the cat\u000bsat"), (103, "the cat\u000bsat"), (None, "the the"), (104, "a " * 5000)]
    same(katz.report(rows(docs, "doc_id long, text string")), brute(docs, katz.SHARE))


def test_table_with_rare_class(spark, folder, monkeypatch):
    docs = table(spark, folder, "documents")
    fit = katz.fit
    monkeypatch.setattr(katz, "fit", lambda d: fit(d, share=1e-3))
    same(katz.report(docs), brute([(r.doc_id, r.text) for r in docs.collect()], 1e-3))


def test_empty(spark, rows):
    assert katz.report(rows([], "doc_id long, text string")).count() == 0
    docs = [(i, "x y") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    row = katz.report(rows(docs, "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


def test_rows_of_one_id_are_scored_by_their_own_texts(spark, rows):
    texts = ["a b a b c", "b", "", "c c c d e f a"]
    model = katz.fit(rows([(i, t * 3) for i, t in enumerate(texts)], "doc_id long, text string"), share=0.1)
    score = lambda docs: [tuple(r)[1:] for r in katz.scores(rows(docs, "doc_id long, text string"), model).collect()]
    alone = score([(i, t) for i, t in enumerate([*texts, texts[0]])])
    for doc in (None, 5):
        together = score([(doc, t) for t in [*texts, texts[0]]])
        for one, two in zip(sorted(alone), sorted(together), strict=True):
            assert two == pytest.approx(one)


def brute_every_word(docs):
    train = [tokens(t) for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    two = Counter(x for t in train for x in zip([None, *t], t))
    d = dict(enumerate(katz.good_turing(Counter(two.values())), 1))
    after = {}
    for (h, w), k in two.items():
        after.setdefault(h, {})[w] = k

    def one(w):
        return (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(w, h):
        own = after.get(h, {})
        disc = {x: d.get(k, 1.0) * k for x, k in own.items()}
        whole = sum(own.values()) + (1 if own and all(k > 5 for k in own.values()) else 0)
        if w in own:
            return disc[w] / whole
        left = 1 - sum(disc.values()) / whole if own else 1
        return left / (1 - sum(map(one, own))) * one(w)

    for h in [*list(c)[:30], "never seen"]:
        assert sum(p(w, h) for w in c) + p("never seen", h) == pytest.approx(1)
    out = []
    for doc, text in docs:
        t = tokens(text)
        held = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
        score = sum(math.log10(p(w, h)) for h, w in zip([None, *t], t))
        out.append((doc, held, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(one(w)) for w in t), score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [katz.SHARE, 0.02, 0.2])
def test_every_word_has_bigrams_of_its_own(spark, rows, monkeypatch, share):
    """What is broadcast changes no score: words seen once have no class."""
    docs = [(i, "The cat sat on the mat the cat " + f"w{i % 7} v{i % 3} " * (i % 5) + f"only{i} tail{i % 11} only{i} z") for i in range(60)]
    docs += [(100, None), (101, ""), (102, "zzz unseen words é"), (103, "the cat\u000bsat"), (103, "only1 tail1"), (None, "the the only2"), (None, "zzz cat"), (104, "a " * 5000)]
    docs += [(200 + i, "x y x y") for i in range(9)]
    fit = katz.fit
    monkeypatch.setattr(katz, "fit", lambda d, **kept: fit(d, share=share, **kept))
    same(katz.report(rows(docs, "doc_id long, text string"), every_word=True), brute_every_word(docs))


def test_every_word_of_the_table(spark, folder):
    docs = table(spark, folder, "documents")
    same(katz.report(docs, every_word=True), brute_every_word([(r.doc_id, r.text) for r in docs.collect()]))
    assert katz.report(docs.limit(0), every_word=True).count() == 0


def test_split_of_parts_of_a_column():
    texts = ["The  cat", " sAt \u00c9a\u000bB ", None, "", "\t", "x" * 40 + " \u2003 The\r\n", "a\u0085b \x1c c", "THE the"] * 50
    whole = pa.array(texts)
    for start, end in ((0, 400), (3, 5), (7, 390), (8, 8)):
        hashes, flat, sizes = katz._split(whole.slice(start, end - start))
        want = [(t or "").encode().lower().split() for t in texts[start:end]]
        assert sizes.tolist() == [len(t) + 1 for t in want]
        assert hashes[flat].tolist() == [x for t in want for x in [*map(katz._hash, t), katz.END]]
        assert len(set(hashes.tolist())) == len(hashes) == len({w for t in want for w in t}) + 1


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(f): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}


def test_shuffled_bytes_of_a_model_of_every_word(spark, rows, tmp_path):
    """Bigrams are shuffled in blocks, not as a row for each text that has one."""
    words, draw = [f"word{i}" for i in range(3000)], random.Random(1)
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(600)]
    rows(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    release(spark)
    before = shuffle_files(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    try:
        assert len(katz.report(table(spark, tmp_path, "documents"), every_word=True).collect()) == 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    written = sum(size for name, size in shuffle_files(spark).items() if name not in before)
    assert written < sum(map(len, texts))
