import re

from wardloom.llm import minhash as mh
from wardloom.llm.common import table


def brute(docs):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(docs)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(own[0], j) for own in where.values() for j in own[1:]}
    pairs |= {(i, j) for own in where.values() if len(own) <= 60 for k, i in enumerate(own) for j in own[k + 1 :]}
    for i, j in pairs:
        if docs[i][0] is None or docs[j][0] is None:
            continue
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    for i in range(n):
        for j in range(i):
            if n < 200 and docs[i][0] is not None and docs[i][0] == docs[j][0]:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if docs[i][0] is not None:
            least[find(i)] = min(least.get(find(i), docs[i][0]), docs[i][0])
    out = []
    for i, (doc, _) in enumerate(docs):
        comp = None if doc is None else least[find(i)]
        out.append((doc, len(sets[i]), comp, doc is None or doc == comp))
    return sorted(out, key=repr)


def ours(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def changed(n, at, base="v"):
    return " ".join(f"{base}{i}" if i not in at else f"new{at}{i}".replace(" ", "") for i in range(n))


def test_cases(spark, rows):
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "one\u000btwo"), (10, "two one"), (11, "a b c d e"), (12, "a b c d"),
            (13, "x y z"), (14, "x y z"), (3, "dup dup dup dup dup dup dup"), (4, "dup dup dup dup dup"), (None, "one two"), (15, "big " * 50000)]
    docs += [(100 + i, changed(200, {3 * i})) for i in range(40)]  # near copies of each other
    docs += [(200 + i, changed(60, {i, i + 30})) for i in range(25)]  # about the limit
    docs += [(90, changed(200, set())), (90, changed(200, set())), (400, changed(200, {50})), (401, changed(200, {50}))]
    got = mh.components(rows(docs, "doc_id long, text string"))
    assert ours(got) == brute(docs)


def test_chain_is_one_component(spark, rows):
    # each is linked with the next only
    docs = [(i * 7 % 31, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 50))) for i in range(20)]
    assert ours(mh.components(rows(docs, "doc_id long, text string"))) == brute(docs)


def test_table_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    assert ours(mh.components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_filter(spark, rows):
    none = rows([], "doc_id long, text string")
    assert mh.components(none).count() == 0
    docs = rows([(2, "A b c d e f", 1), (1, "a b c d e f", 2), (3, None, 3), (4, None, 4)], "doc_id int, text string, comp int")
    kept = mh.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 2000, np.uint64)
    two = np.concatenate([one[:1500], rng.integers(0, 1 << 63, 500, np.uint64)])
    same = (mh.signature(one) == mh.signature(two)).mean()
    assert abs(same - 1500 / 2500) < 0.15
