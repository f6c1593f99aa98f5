import pytest

from wardloom.llm import html_text as ht
from wardloom.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We use <b>cookies</b></div>{body}<aside>Side</aside><form><p>Mail</p><input></form><footer>&copy; us</footer></body></html>"""
ARTICLE = '<article><header><h1>Head  line</h1></header><p>One &amp;amp; <b>two\n three<br>four<p>Five &eacute;&#8364;<div class="comments"><p>Nice!</p></div></article>'


def texts(spark, rows, pages):
    return {r.page_id: r.text for r in ht.main_texts(rows(pages, "page_id long, url string, html string")).collect()}


def test_article(spark, rows):
    got = texts(spark, rows, [(1, "http://a/x", PAGE.format(body=ARTICLE))])
    assert got == {1: "Head line\n\nOne &amp; two three four\n\nFive é€"}


def test_differencing(spark, rows):
    body = "<div>Welcome to our site</div><div>{}</div><div>{}</div><p>Tell your friends about it</p>"
    pages = [(i, f"http://Host/{p}?q=1", PAGE.format(body=body.format(f"Story {i} goes like this and on", f"End {i}"))) for i, p in enumerate("abcd")]
    pages += [(9, "http://other/a", "<div>Welcome to our site</div>"), (10, None, None), (11, "", ""), (12, "nonsense", "a < b <p>c"), (12, "nonsense", "a < b <p>c")]
    got = texts(spark, rows, pages)
    for i in range(4):
        assert got[i] == f"Story {i} goes like this and on\n\nEnd {i}"
    assert got[9] == "Welcome to our site"
    assert (got[10], got[11], got[12]) == ("", "", "a < b\n\nc")


def test_mirrors_keep_their_text(spark, rows):
    pages = [(i, f"http://h/{i}", "<div>Menu</div><p>The same long story on both pages</p>") for i in range(2)]
    assert texts(spark, rows, pages) == {0: "Menu\n\nThe same long story on both pages", 1: "Menu\n\nThe same long story on both pages"}
    pages = [(i, f"http://h/{i}", PAGE.format(body=ARTICLE)) for i in range(3)]
    assert set(texts(spark, rows, pages).values()) == {"Head line\n\nOne &amp; two three four\n\nFive é€"}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(12))] for _ in range(2))
        found = ht.shared_lines(a, b)
        assert found == sorted(set(found))
        assert len(found) == lcs(ht.numbered(a), ht.numbered(b))


def test_table_and_empty(spark, folder, rows):
    pages = table(spark, folder, "pages")
    out = ht.main_texts(pages).collect()
    assert len(out) == pages.count()
    html = {r.page_id: r.html for r in pages.collect()}
    for r in out:
        lines, inner = ht.lines_of(html[r.page_id])
        assert r.text == "\n\n".join(t for t, i in zip(lines, inner) if i) and r.n_chars == len(r.text)
    assert ht.main_texts(pages.limit(0)).count() == 0


def test_long_and_broken():
    assert ht.lines_of("<p>" * 50_000 + "x")[0] == ["x"]
    assert ht.lines_of("<div>" * 5000 + "x" + "</div>" * 5000)[0] == ["x"]
    assert ht.lines_of("<a href='" + "y" * 1000)[0] == ["<a href='" + "y" * 1000]
    assert ht.lines_of("<nav>menu<p>more</nav>text")[0] == ["text"]


def test_differencing_decides_inside_articles(spark, rows):
    body = '<div class="layout sidebar"><article><p>Read more on our site</p><p>Story {0} goes like this and on</p></article></div><div>Seen outside {0}</div><div>Welcome</div>'
    pages = [(i, f"http://h/{p}", PAGE.format(body=body.format(i))) for i, p in enumerate("abcd")]
    # exact and near copies between b and c are passed over; teasers do not replace a body
    pages += [(10 + i, f"http://h/b{i}", pages[1][2]) for i in range(3)]
    pages += [(20, "http://t/a", "<article>Teaser</article><div>The real body of this page</div>")]
    got = texts(spark, rows, pages)
    assert got == {
        **{i: f"Story {i} goes like this and on\n\nSeen outside {i}" for i in range(4)},
        **{10 + i: "Story 1 goes like this and on\n\nSeen outside 1" for i in range(3)}, 20: "Teaser\n\nThe real body of this page",
    }


def test_ranges_do_not_matter(spark, rows):
    import random

    r = random.Random(7)
    pages = []
    for i in range(60):
        same = r.random() < 0.5
        lines = ["Menu of the site", "Shared " * r.randrange(1, 3), f"Own story {0 if same else i} " * 20]
        pages.append((i, f"http://h{i // 40}/{i:03}", "".join(f"<div>{x}</div>" for x in lines) + f"<main><p>{lines[1]}</p><p>Main {i}</p></main>"))
    got = {}
    try:
        for n in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got[n] = texts(spark, rows, pages)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[1] == got[40] and not any("Menu" in t for t in got[1].values())


def test_template_heavy_pages_are_no_copies(spark, rows):
    """Two lines of their own among forty of the site: the template goes, the lines stay."""
    menu = "".join(f"<div>Menu entry number {i} of the site</div>" for i in range(40))
    pages = [(i, f"http://h/{i:02}", f"{menu}<div>Own {i}</div><p>And more {i}</p>") for i in range(8)]
    assert texts(spark, rows, pages) == {i: f"Own {i}\n\nAnd more {i}" for i in range(8)}


def test_sentences_shared_by_chance_stay(spark, rows):
    """Neighbours that share a sentence of their articles keep it; a line on half of all pages of the host goes."""
    body = "<article><p>Subscribe to our letter</p><p>{}</p><p>Own story {} and so on</p></article>"
    said = ["Les.", "Les.", "Les.", "Un.", "Deux.", "Trois.", "Quatre.", "Cinq."]
    pages = [(i, f"http://h/{i}", body.format(x, i)) for i, x in enumerate(said)]
    assert texts(spark, rows, pages) == {i: f"{x}\n\nOwn story {i} and so on" for i, x in enumerate(said)}


def brute(pages):
    """Differencing by plain loops over {id: (host, path, [(line, inner)])}; no near copies, only exact ones."""
    out = {}
    hosts = {}
    for i, (host, path, lines) in pages.items():
        hosts.setdefault(host, []).append((path, i, lines))
    for own in hosts.values():
        own.sort()
        n = len(own)
        seen = {}
        for _, _, lines in own:
            for text in {t for t, _ in lines}:
                seen[text] = seen.get(text, 0) + 1
        common = {t for t, k in seen.items() if k >= ht.COMMON_PAGES and 2 * k >= n}
        for place, (_, i, lines) in enumerate(own):
            gone, votes = set(), []
            for step in (-1, 1):
                j = place + step
                while 0 <= j < n and [t for t, _ in own[j][2]] == [t for t, _ in lines]:
                    j += step
                if 0 <= j < n:
                    shared = set(ht.shared_lines([t for t, _ in lines], [t for t, _ in own[j][2]]))
                    gone |= {k for k in shared if not lines[k][1]}
                    votes.append({k for k in shared if lines[k][1] and lines[k][0] in common})
            if votes:
                gone |= set.intersection(*votes)
            out[i] = "\n\n".join(t for k, (t, _) in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_against_brute_force(spark, rows, monkeypatch, few):
    import random

    monkeypatch.setattr(ht, "BROADCAST_LINES", few)

    r = random.Random(11)
    pages, rows_ = {}, []
    for i in range(120):
        host = f"h{r.randrange(4)}"
        outer = [f"Top {x}" for x in range(3)] + ([f"Chance {r.randrange(3)}"] if r.random() < 0.3 else [])
        inner = [x for x in ("Letter", "Advert") if r.random() < 0.8] + [f"Some chance {r.randrange(5)}", f"Own {i} " + "word " * 30]
        lines = [(" ".join(t.split()), k >= len(outer)) for k, t in enumerate(outer + inner)]
        if pages and r.random() < 0.2:
            host, _, lines = pages[r.choice(list(pages))]
        pages[i] = host, f"{i:03}", lines
        rows_.append((i, f"http://{host}/{i:03}", "".join(f"<div>{t}</div>" for t, k in lines if not k) + "<article>" + "".join(f"<p>{t}</p>" for t, k in lines if k) + "</article>"))
    assert texts(spark, rows, rows_) == brute(pages)
