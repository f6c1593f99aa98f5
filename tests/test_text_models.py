import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.functions import numeric
from wardloom.functions.lookups import stop_words
from wardloom.operators import features, heads, models

DOCS = [
    (1, "The heart failure of the HEART, failure-risk x 42"),
    (2, "Sepsis and pneumonia; pneumonia again_today"),
    (3, ""),
    (4, None),
    (5, "élan vital 漢字 heart"),
]


def brute_terms(text, stop=None):
    stop = set(stop_words()) if stop is None else stop
    words = [w for w in re.findall(r"\w\w+", (text or "").lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.fixture
def docs(rows):
    return rows(DOCS, "doc_id long, text string")


def test_terms(docs):
    got = {r.doc_id: r.terms for r in features.with_terms(docs, "text").collect()}
    assert got == {i: brute_terms(t) for i, t in DOCS}


def test_vocabulary_ties_are_alphabetical(docs):
    counts = Counter(t for _, text in DOCS for t in brute_terms(text))
    expected = [t for t, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:5]]
    got = [r.term for r in features.vocabulary(features.with_terms(docs, "text"), max_terms=5).collect()]
    assert got == expected


def test_tfidf(docs):
    model = features.fit_tfidf(docs, "text", max_terms=8)
    got = {(r.doc_id, r.term): r.weight for r in model.weights(docs, "doc_id", "text").collect()}
    expected = {}
    for doc, text in DOCS:
        counts = Counter(t for t in brute_terms(text) if t in model.terms)
        raw = {}
        for term, n in counts.items():
            df = sum(term in brute_terms(t) for _, t in DOCS)
            raw[term] = n * (math.log((1 + len(DOCS)) / (1 + df)) + 1)
        norm = math.sqrt(sum(w * w for w in raw.values()))
        expected |= {(doc, t): w / norm for t, w in raw.items()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_encoding(rows):
    df = rows([(1, "aa bb zz"), (2, "aa bb aa bb aa bb aa bb aa bb"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in features.encode_fixed_length(df, "text", ["aa", "bb"], 6).collect()}
    assert got[1].input_ids == [2, 4, 5, 1, 3, 0] and got[1].attention_mask == [1, 1, 1, 1, 1, 0]
    assert got[2].input_ids == [2, 4, 5, 4, 5, 3] and got[2].attention_mask == [1] * 6
    assert got[3].input_ids == got[4].input_ids == [2, 3, 0, 0, 0, 0]
    assert got[4].attention_mask == [1, 1, 0, 0, 0, 0]


def test_logits(rows):
    df = rows([([1.0, 3.0, 3.0],), ([1000.0, -1000.0, 0.0],)], "x array<double>")
    got = df.select(numeric.softmax(F.col("x")).alias("p"), numeric.class_probability(F.col("x")).alias("p1"),
                    numeric.argmax(F.col("x")).alias("c")).collect()
    assert sum(got[0].p) == pytest.approx(1) and got[0].p[1] == pytest.approx(got[0].p1)
    assert got[0].p1 == pytest.approx(math.exp(2) / (1 + 2 * math.exp(2)))
    assert [r.c for r in got] == [1, 0] and got[1].p1 == 0.0


def test_first_vector(rows):
    df = rows([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "x array<array<double>>")
    assert [r[0] for r in df.select(numeric.first_vector(F.col("x"))).collect()] == [[1.0, 2.0], None]


def test_heads(rows):
    rng = np.random.default_rng(0)
    stack = [(rng.normal(size=(4, 8)), rng.normal(size=8)), (rng.normal(size=(8, 2)), rng.normal(size=2))]
    vectors = rng.normal(size=(20, 4))
    df = rows([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<double>")
    got = {r.id: r for r in heads.classifier_scores(df.coalesce(1), "v", stack).collect()}
    logits = np.maximum(vectors @ stack[0][0] + stack[0][1], 0) @ stack[1][0] + stack[1][1]
    p = np.exp(logits[:, 1]) / np.exp(logits).sum(axis=1)
    assert all(got[i].prob == pytest.approx(p[i]) and got[i].pred == int(logits[i].argmax()) for i in range(20))
    assert got[99].prob is None and got[99].pred is None
    with pytest.raises(ValueError):
        heads.head_outputs(df, "v", [stack[0], stack[0]])


@pytest.fixture(scope="module")
def planted(spark):
    """A label and a length that two words give away, mostly."""
    df = spark.range(600).select(
        F.col("id"),
        F.concat_ws(" ", F.when(F.col("id") % 3 == 0, F.lit("shock")).otherwise(F.lit("stable")),
                    F.format_string("w%d", F.col("id") % 11)).alias("text"),
        F.when(F.col("id") % 20 == 0, 0).when(F.col("id") % 3 == 0, 1).otherwise(0).alias("hospital_expire_flag"),
        F.when(F.col("id") % 3 == 0, 9.0).otherwise(2.0).alias("los_days"),
    )
    return features.fit_tfidf(df, "text", 30).transform(df, "text").cache()


def test_boosting_finds_signal(planted):
    from wardloom.operators.metrics import regression_metrics, roc_auc

    train, val = planted.where("id % 5 > 0"), planted.where("id % 5 = 0")
    model = models.fit_mortality(train, trees=4)
    scored = models.score_mortality(model, val)
    assert scored.where("prob < 0 or prob > 1 or pred not in (0, 1)").count() == 0
    auc = roc_auc(scored.withColumnRenamed("hospital_expire_flag", "label")).first().auc_roc
    assert auc > 0.8

    history = models.mortality_history(model, train, val).collect()
    assert [r.iteration for r in history] == [1, 2, 3, 4]
    assert history[-1].train_loss < history[0].train_loss
    assert history[-1].val_auc == pytest.approx(auc)

    last = models.score_at_iteration(model, val, 4).select("id", F.round("prob", 9).alias("p"))
    assert last.exceptAll(scored.select("id", F.round("prob", 9).alias("p"))).count() == 0

    stay = models.fit_stay(train, trees=4)
    scored_stay = models.score_stay(stay, val)
    assert regression_metrics(scored_stay).first().r2 > 0.8
    rows = models.stay_history(stay, train, val).collect()
    assert rows[-1].val_loss == pytest.approx(regression_metrics(scored_stay).first().mse)


def test_vector_heads(spark):
    df = spark.range(200).select(
        (F.col("id") % 2).cast("int").alias("y"),
        F.array(*[(F.sin(F.col("id") * k) + (F.col("id") % 2) * 3).cast("float") for k in (1, 2, 3)]).alias("v"),
    )
    model = models.fit_vector_classifier(df, "v", "y", 2, width=4, iterations=30)
    scored = models.score_vectors(model, df, "v")
    assert scored.where("prob < 0 or prob > 1").count() == 0
    assert scored.where("y = pred").count() > 180
    stay = models.score_vectors(models.fit_vector_regressor(df, "v", "y", trees=2), df, "v", "los_pred")
    assert stay.agg(F.avg(F.abs(F.col("los_pred") - F.col("y")))).first()[0] < 0.3


def test_terms_are_counted_in_tasks_of_bounded_text(spark, rows, monkeypatch):
    made = [(i, " ".join(f"w{i}x{j} common" for j in range(50))) for i in range(200)] + [(200, None)]
    docs = rows(made, "doc_id long, text string").coalesce(1)
    expected = features.fit_tfidf(docs, "text", 40)
    monkeypatch.setattr(features, "TASK_BYTES", 8_000, raising=False)
    counted, count = [], features.term_counts
    monkeypatch.setattr(features, "term_counts", lambda d, *a, **k: counted.append(d) or count(d, *a, **k))
    assert features.fit_tfidf(docs, "text", 40) == expected
    assert features.fit_word_ids(docs, "text", 3)[0] == "common"
    size = sum(len(text or "") for _, text in made)
    assert all(d.rdd.getNumPartitions() >= size / 8_000 for d in counted) and len(counted) == 2
