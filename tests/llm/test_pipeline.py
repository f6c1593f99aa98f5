import corpus_pipeline as cp
from test_decontaminate import brute as contamination
from test_minhash import brute as near_copies
from test_token_ids import expected

from wardloom.llm import knn_quality, mixing, registry
from wardloom.llm.common import table


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents").persist()
    labels, items = table(spark, folder, "labels"), table(spark, folder, "benchmark")
    text = {r.doc_id: r.text for r in docs.collect()}
    step = docs
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, step, folder).persist()
        assert after.columns == docs.columns
        kept[name] = ({r.doc_id for r in step.collect()}, {r.doc_id for r in after.collect()})
        step = after
    before, after = kept["quality classifier"]
    model = knn_quality.fit(docs, labels.where(~knn_quality.held_out()))
    score = {r.doc_id: r.score for r in knn_quality.scored(docs, model).collect()}
    assert after == {d for d in before if score[d] >= 0.5}
    before, after = kept["near duplicates"]
    assert after == {d for d, _, _, keep in near_copies([(d, text[d]) for d in before]) if keep}
    before, after = kept["benchmark decontamination"]
    found = contamination([(d, text[d]) for d in before], [(r.item_id, r.text) for r in items.collect()])
    assert after == {row[0] for row in found if not row[-1]}
    before, after = kept["mixing"]
    assert after <= before and len(after) > 0.8 * len(before)
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()} & before
    assert len(clean & after) >= 0.99 * len(clean)
    out = cp.STAGES[-1][1](spark, step, folder)
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == expected([(d, text[d]) for d in after])


def test_run_and_registry(spark, folder):
    assert cp.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_mixing_repeats_only_if_allowed(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    once = mixing.sampled(docs, labels, (0.5, 0.3, 0.2), max_rate=1.0)
    assert once.groupBy("doc_id").count().where("count > 1").count() == 0
