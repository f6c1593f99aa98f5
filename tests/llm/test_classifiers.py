import numpy as np
import pytest

from wardloom.llm import knn_quality as kq
from wardloom.llm import toxicity as tx
from wardloom.llm.common import table

BIG = "/root/testdata/sf0.01"


def auc(score, label):
    score, label = np.array(score), np.array(label)
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("op, column, least", [(kq, "quality", 0.98), (tx, "toxic", 0.9)])
def test_held_out_accuracy(spark, op, column, least):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    found = op.report(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(held.score, held[column]) >= least


@pytest.mark.parametrize("op", [kq, tx])
def test_cases(spark, rows, op):
    docs = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "x"), (4, "w " * 50_000), (5, "z" * 300_000), (6, "!")]
    docs = rows(docs, "doc_id long, text string")
    labels = rows([(3, 1, 0), (3, 1, 0), (6, 0, 1), (None, 1, 1), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    out = op.report(docs, labels).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert len({r.score for r in op.report(docs, none).collect()}) == 1
    assert op.report(docs.limit(0), labels).count() == 0


def test_filter_keeps_columns(spark, rows):
    docs = rows([(1, "some words", 0.5), (2, None, None)], "doc_id int, text string, Score double")
    labels = rows([(1, 1)], "doc_id int, quality int")
    assert kq.without_low_quality(docs, labels).columns == docs.columns


def test_votes_against_brute_force():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 300).astype(float)
    model = kq.Model(np.zeros(0), np.zeros(0), np.zeros((0, 6)), vectors, labels, 0.3)
    asked = np.vstack([rng.standard_normal((700, 6)), np.zeros((1, 6))])
    asked[:-1] /= np.linalg.norm(asked[:-1], axis=1, keepdims=True)
    got = model.scores(asked)
    for v, score in zip(asked, got):
        near = sorted(range(300), key=lambda i: -(v @ vectors[i]))[: kq.NEIGHBOURS]
        weight = [max(v @ vectors[i], 0) ** kq.POWER for i in near]
        want = sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) > 1e-9 else 0.3
        assert score == pytest.approx(want, abs=1e-6)


def test_margins_tell_dictionaries_apart():
    d = tx.Dictionaries(b" horrible dreadful ", b" pleasant agreeable ")
    assert d.of({b"dreadful"})[0] >= 3 and d.of({b"agreeable"})[0] <= -3 and abs(d.of({b"qzxvkj"})[0]) <= 1


def test_equal_cosines_go_to_the_first():
    """Copies among the labelled rows that disagree: which of them vote does not depend on the block."""
    one = np.zeros((60, 4), np.float32)
    one[:, 0] = 1
    labels = np.array([1.0] * kq.NEIGHBOURS + [0.0] * (60 - kq.NEIGHBOURS))
    model = kq.Model(np.zeros(0), np.zeros(0), np.zeros((0, 4)), one, labels, 0.5)
    asked = np.tile(np.array([[0.6, 0.8, 0, 0]], np.float32), (1100, 1))
    assert set(model.scores(asked)) == {1.0}
    model.labels = labels[::-1].copy()
    assert set(model.scores(asked)) == {0.0}


def test_one_text_of_a_labelled_id(spark, rows):
    """A labelled id with many texts is one labelled row."""
    docs = rows([(1, f"text {i}") for i in range(300)] + [(2, "other")], "doc_id long, text string")
    model = kq.fit(docs, rows([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert len(model.labels) == 2 and model.share == 0.5


def test_thresholds_are_calibrated():
    """The levels that only documents of one kind reach are found."""
    rng = np.random.default_rng(0)
    toxic = rng.integers(0, 2, 400)
    found = np.array([tx.statistics([*rng.integers(-4, 4, 20).tolist(), 6 if t else 3]) for t in toxic])
    first, second = tx.best_thresholds(found, toxic)
    assert 4 <= first < second <= 6
    model = tx.calibrate(tx.Dictionaries(b"", b""), found, toxic.astype(float), np.ones(400))
    assert auc(model.scores(found), toxic) > 0.99
