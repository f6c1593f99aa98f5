"""Other columns, named like the operators' own, and the pipeline over small odd tables."""

import pytest

import corpus_pipeline as cp
from wardloom.llm import decontaminate, katz, knn_quality, minhash, mixing, pii, quality_rules, suffix_dedup, token_ids, toxicity
from wardloom.llm.registry import default_tokenizer

EXTRA = "Score string, key string, row string, copies string, DOC string, part string, n string, start string, hash string, words string, Label string, code string, rate string"
KIND = f"doc_id long, text string, {EXTRA}"
TEXTS = ["one two three four five six seven eight nine ten", None, "", "one two three four five six seven eight nine ten", "other words that are here " * 30]


@pytest.fixture
def docs(rows):
    extra = ["x"] * len(EXTRA.split(","))
    return rows([(i, t, *extra) for i, t in enumerate(TEXTS)] + [(None, "nobody", *extra)], KIND)


@pytest.fixture
def labels(rows):
    return rows([(0, 1, 0), (4, 0, 1), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")


def test_reports_ignore_other_columns(spark, docs, labels, rows):
    benchmark = rows([(1, TEXTS[0], "s")], "item_id long, text string, Text2 string")
    plain = docs.select("doc_id", "text")
    for report in (
        lambda d: token_ids.tokenized(d, default_tokenizer()), katz.report, suffix_dedup.deduplicated, minhash.components, pii.report,
        lambda d: toxicity.report(d, labels), lambda d: knn_quality.report(d, labels), lambda d: quality_rules.report(d, labels),
        lambda d: decontaminate.report(d, benchmark), lambda d: mixing.mixed(d, labels, (0.9, 0.05, 0.05)),
    ):
        got, want = report(docs), report(plain)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.count() == len(TEXTS) + 1


def test_filters_keep_other_columns(spark, docs, labels, rows):
    benchmark = rows([(1, "not in any document at all")], "item_id long, text string")
    for filtered in (
        knn_quality.without_low_quality(docs, labels), minhash.without_near_duplicates(docs),
        decontaminate.without_contaminated(docs, benchmark), mixing.sampled(docs, labels, (0.9, 0.05, 0.05)),
        pii.redacted(docs, pii.fit(docs)), toxicity.scored(docs, toxicity.fit(docs, labels), "score2").drop("score2"),
    ):
        assert filtered.columns == docs.columns
        assert all(r.key == "x" and r.Score == "x" for r in filtered.collect())


@pytest.mark.parametrize("which", ["odd", "no labels", "no documents"])
def test_pipeline_over_odd_tables(spark, rows, tmp_path, which):
    """Null texts, null and repeated ids, empty tables: every stage gives a result of its own columns."""
    texts = TEXTS + ["same words " * 20] * 3 + ["unlike all others " + " ".join(f"w{i}" for i in range(80))]
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id " * 10, None, None, None), (3, TEXTS[3], "en", "s", 10)]
    documents = rows(data if which != "no documents" else [], "doc_id long, text string, lang string, source string, n_chars long")
    known = [(0, 1, 0), (4, 0, 0), (8, 1, 1), (None, None, None)] if which == "odd" else []
    for name, frame in (
        ("documents", documents), ("labels", rows(known, "doc_id long, quality int, toxic int")),
        ("benchmark", rows([(1, None), (2, "")], "item_id long, text string")),
    ):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, step, str(tmp_path))
        assert after.columns == step.columns and after.count() <= step.count()
        step = after
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.count() == step.count() and (which != "no documents" or out.count() == 0)
