import hashlib
import re

import pytest

from wardloom.llm import decontaminate as dc
from wardloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        if item is None:
            continue
        own = words(text)
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if owners := windows.get(tuple(own[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def ours(df):
    keep = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in keep) for r in df.collect()), key=repr)


LONG = " ".join(f"w{i}" for i in range(40))
DOCS = [
    (1, "x " * 50 + LONG.upper() + " y"), (2, None), (3, ""), (4, "!!!"), (5, "Short Item; here"), (6, LONG[30:90]),
    (7, "w1 " * 30), (7, "w1 " * 30), (8, " ".join(f"w{i}" for i in range(5, 18)) + " z" * 300), (None, "short item here"),
    (9, "ünï " + LONG + " q " * 5 + LONG), (10, "w " * 60000 + LONG),
]
ITEMS = [(1, LONG), (2, "short, item HERE"), (3, None), (4, "??"), (5, LONG), (None, "w1 w1"), (6, "w1 " * 14), (6, "ünï w0"), (6, "ünï w0")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_against_brute_force(spark, rows, block):
    docs = rows(DOCS, "doc_id long, text string")
    items = rows(ITEMS, "item_id int, text string")
    assert ours(dc.report(docs, items, block_bytes=block)) == brute(DOCS, ITEMS)


def test_table_against_brute_force(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ours(dc.report(docs, items)) == expected


def test_longest_match(spark, rows):
    got = dc.report(rows([(1, "a b " + LONG + " c")], "doc_id long, text string"), rows([(9, "z " + LONG)], "item_id int, text string"))
    row = got.first()
    assert (row.longest, row.longest_item, row.longest_at) == (40, "9", 2)


def test_filter_keeps_columns_and_clean_rows(spark, rows):
    docs = rows([(1, "a", LONG, 5), (2, "b", "clean text", 6), (3, "c", None, None)], "doc_id long, items string, text string, N_words int")
    items = rows([(1, LONG)], "item_id int, text string")
    kept = dc.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [2, 3]


def test_empty_tables(spark, rows):
    none = rows([], "item_id int, text string")
    docs = rows([(1, "a b")], "doc_id long, text string")
    assert ours(dc.report(docs, none)) == brute([(1, "a b")], [])
    assert dc.report(docs.limit(0), rows([(1, "a")], "item_id int, text string")).count() == 0


def brute_longest(docs, items):
    items = sorted({(str(i), tuple(words(t))) for i, t in items if i is not None and words(t)})
    least = min((min(13, len(own)) for _, own in items), default=13)
    out = []
    for doc, text in docs:
        own, best = words(text), (0,)
        number = 0
        for item, theirs in items:
            for b in range(len(theirs)):
                for a in range(len(own)):
                    n = 0
                    while a + n < len(own) and b + n < len(theirs) and own[a + n] == theirs[b + n]:
                        n += 1
                    if n >= least:
                        best = min(best, (-n, number, a, item))
                number += 1
        out.append((doc, -best[0], best[3] if best[0] else None, best[2] if best[0] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("short", [True, False])
def test_longest_match_of_every_document(spark, rows, short):
    start = " ".join(f"w{i}" for i in range(14))
    docs = [(i, f"a{i} " + LONG + f" b{i}") for i in range(5)] + [(8, LONG), (9, LONG)]
    docs += [(20 + i, f"{start} x {start} w14 w15 y{i} {start} w14 z") for i in range(3)]
    docs += [(30 + i, "u short item q item here") for i in range(3)] + [(40, "w1 " * 20), (41, "w1 " * 20), (42, "none"), (43, None)]
    items = [(1, LONG), (2, start + " x y"), (3, "w1 " * 17), (4, LONG)] + [(5, "short item here"), (6, "item q")] * short
    got = dc.report(rows(docs, "doc_id long, text string").coalesce(1), rows(items, "item_id int, text string"))
    found = sorted(((r.doc_id, r.longest, r.longest_item, r.longest_at) for r in got.collect()), key=repr)
    assert found == brute_longest(docs, items)
