"""Main text of web pages by differencing pages with near URLs.

1. *Lines.* Markup is cut into text lines, one for each block. Lines inside
   scripts, styles, menus, footers, side bars, forms and the like, or inside
   elements whose class, id or role names such a part, are none; an article or
   main element is not dropped for a class or id around it. A line is *inner*
   if it stands in an article or main element.
2. *Common lines* are on at least half of the pages of their host, and on
   ``COMMON_PAGES`` of them or more. They are counted per task before the shuffle;
   a host has at most twice as many as its pages have lines on average.
3. *Mates.* Pages are put in order of host and URL path; a page's mates are the
   nearest page before and the nearest after it on the same host that are not
   copies of it. A copy shares over ``COPY`` of its own characters, which are those
   of inner lines and of lines that are not common, so that pages of one large
   template are no copies. Only keys and line hashes go into that order, which is
   dealt out by ranges, so a host with a third of all pages is many tasks; across
   the ends of the ranges, pages are compared with at most two pages of each side.
4. *Differencing.* The lines of a page and of each mate are aligned by a longest
   common subsequence, the n-th occurrence of a line matching the n-th. A line
   that a mate shares is deleted; an inner one only if it is common and all mates
   share it, so that a sentence that two neighbours happen to share stays.
5. *Text* is what is left of all lines.

A run of copies is passed by the mate that its neighbour in the run found, so
each page is compared with a few others however long the run is.

Lines travel as hashes; the texts are shuffled once, in the last join.

Defined cases: a null or empty html has an empty text; a null or odd URL is a
host of its own name; equal rows (id, URL, html) have equal texts and each
stays; a page without lines is nobody's mate; a page without a mate keeps its
lines; unclosed elements end with their parent; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import with_columns_by_batch
from wardloom.sources.sinks import materialized

COPY = 0.9
COMMON_PAGES = 4
BROADCAST_LINES = 1 << 19
SALTS = 16

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe|noframes|noscript|svg|math)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup td th time tt u var wbr br picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTER = frozenset("nav footer aside form button select dialog menu template object audio video canvas head".split())
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer login masthead menu modal nav navbar navigation newsletter notice popup promo promoted related reply "
    "replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)


def _is_part(name: str, attributes: str, inside_main: bool) -> int:
    """Whether an element starts a part that is not the article: 1, or 2 if only its class or id says so."""
    if name in OUTER or (name == "header" and not inside_main):
        return 1
    if not attributes or name in MAIN or name in ("html", "body"):
        return 0
    part = 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if key in ("class", "id") and any(w.lower() in PARTS for w in _NAME.findall(value)):
            part = 2
        if (key == "role" and value.lower() in ROLES) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 1
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return 1
    return part


def lines_of(page: str) -> tuple[list[str], list[bool]]:
    """The text lines of a page in order, and whether each is inner."""
    texts: list[str] = []
    inner: list[bool] = []
    held: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # element, starts a part, starts the main text, named parts around it
    parts = named = mains = at = 0  # parts by element or role, parts by class or id

    def flush() -> None:
        if held:
            line = " ".join(entities.unescape("".join(held)).split())
            if line:
                texts.append(line)
                inner.append(mains > 0)
            held.clear()

    for mark in _MARK.finditer(page):
        if not parts and not named and mark.start() > at:
            held.append(page[at : mark.start()])
        at = mark.end()
        name = mark[3]
        if name is None:
            if mark[1] or not mark[0].startswith("<!--"):
                held.append(" ")
            continue
        name = name.lower()
        if name in INLINE:
            if name in ("br", "td", "th", "img") and not parts and not named:
                held.append(" ")
        else:
            flush()
        if mark[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for _, part, main, around in reversed(stack[i:]):
                        parts -= part == 1
                        named -= part == 2
                        mains -= main
                        if main and not mains:
                            named = around
                    del stack[i:]
                    break
        elif name not in VOID and not mark[4].endswith("/"):
            part, main = _is_part(name, mark[4], mains > 0), name in MAIN
            # plain inline and paragraph tags need no place on the stack
            if part or main or name not in INLINE and name not in ("p", "li", "dt", "dd", "tr", "option"):
                stack.append((name, part, main, named))
                if main and not mains:
                    named = 0
                parts += part == 1
                named += part == 2
                mains += main
    if not parts and not named and at < len(page):
        held.append(page[at:])
    flush()
    return texts, inner


def numbered(lines: list[int]) -> list[tuple[int, int]]:
    seen: dict[int, int] = {}
    out = []
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
        out.append((x, seen[x]))
    return out


def shared_lines(ours: list[int], theirs: list[int]) -> list[int]:
    """Places in ``ours`` of a longest common subsequence of the numbered lines."""
    where = {x: i for i, x in enumerate(numbered(theirs))}
    tails: list[int] = []
    tail_at: list[int] = []
    before: dict[int, int] = {}
    for i, x in enumerate(numbered(ours)):
        j = where.get(x)
        if j is None:
            continue
        k = bisect_left(tails, j)
        before[i] = tail_at[k - 1] if k else -1
        tails[k : k + 1] = [j]
        tail_at[k : k + 1] = [i]
    out = []
    i = tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.xxhash64("page_id", "url", "html"))


def _signatures(keyed: DataFrame) -> DataFrame:
    """(key, url, hashes, sizes) of each page; the sizes of inner lines are negative."""
    kind = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def compute(column: pa.Array) -> list:
        found = [lines_of(p) for p in column.to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts] for texts, _ in found]
        return [hashes, [[-len(t) if i else len(t) for t, i in zip(*lines)] for lines in found]]

    return with_columns_by_batch(keyed, "html", kind, compute, keep=["key", "url"])


def _with_common(found: DataFrame) -> DataFrame:
    """Put into the sizes which lines are common: twice the size, and one more for a common line.

    The common lines of all hosts are broadcast where they are counted to be
    few; else they are joined by host and salt, so that a host with a third of
    all pages is many tasks.
    """
    host = F.xxhash64("host").alias("site")
    each = found.select(host, F.explode(F.array_distinct("hashes")).alias("line"))
    counted = each.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_PAGES)
    pages = found.where(F.size("hashes") > 0).groupBy(host).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= COMMON_PAGES)
    common = counted.join(pages, "site").where(2 * F.col("n") >= F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("common"))
    common = materialized(common, "html-common")
    keyed = found.withColumn("site", host)
    few = (common.agg(F.sum(F.size("common") + 2)).first()[0] or 0) <= BROADCAST_LINES
    if few:
        joined = keyed.join(F.broadcast(common), "site", "left")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["site", "salt"], "left")
    flag = lambda h: F.coalesce(F.array_contains("common", h), F.lit(False)).cast("int")
    coded = F.zip_with("hashes", "sizes", lambda h, s: F.when(s < 0, 2 * s - flag(h)).otherwise(2 * s + flag(h)))
    return joined.select("key", "host", "path", "hashes", coded.alias("sizes"))


def _differing(hashes: np.ndarray, sizes: np.ndarray, theirs: np.ndarray) -> list[int] | None:
    """Places of the lines shared with another page; None if that is a copy."""
    if len(hashes) == len(theirs) and (hashes == theirs).all():
        return None
    shared = shared_lines(hashes.tolist(), theirs.tolist())
    size = np.abs(sizes)
    own = np.where((sizes > 0) & (size % 2 == 1), 0, size // 2)
    return None if own.any() and int(own[shared].sum()) > COPY * int(own.sum()) else shared


def _nearest(pages: list[tuple], step: int) -> list[tuple[int, list[int]] | None]:
    """For each page of one host the nearest that is no copy of it, before (step -1) or after it (1), and what they share."""
    found: list[tuple[int, list[int]] | None] = [None] * len(pages)
    for i in range(len(pages)) if step < 0 else reversed(range(len(pages))):
        j = i + step
        while 0 <= j < len(pages):
            shared = _differing(pages[i][1], pages[i][2], pages[j][1])
            if shared is not None:
                found[i] = j, shared
                break
            if found[j] is None:  # copies up to the end
                break
            j = found[j][0]
    return found


_FOUND = "key long, shard int, side int, kind int, host string, hashes array<long>, sizes array<int>, outer array<int>, inner array<int>"
# kinds of rows: a mate's shared lines; a page whose mate is not in its range; pages at the end of a range
_SHARED, _OPEN, _END = range(3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)


def _shared_row(key: int, sizes: np.ndarray, shared: list[int]) -> tuple:
    outer, inner = [i for i in shared if sizes[i] > 0], [i for i in shared if sizes[i] < 0 and sizes[i] % 2]
    return (key, None, None, _SHARED, None, None, None, outer, inner)


def _compared(signatures: DataFrame) -> DataFrame:
    """Rows of ``_FOUND``: what the mates in a range share, and what is to be compared across its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        host, pages, first = None, [], True

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            rows = []
            for side, step in enumerate((-1, 1)):
                found = _nearest(pages, step)
                at_end = last if side else first
                for (key, hashes, sizes), mate in zip(pages, found):
                    if mate is not None:
                        rows.append(_shared_row(key, sizes, mate[1]))
                    elif at_end:
                        rows.append((key, shard, side, _OPEN, host, hashes, sizes, None, None))
                    if len(rows) >= 1024:
                        yield _batch(rows)
                        rows = []
                # what the next range (side 0) or the one before (side 1) may see: the page at the end, and the nearest that differs
                if first if side else last:
                    end = 0 if side else len(pages) - 1
                    for place, p in enumerate([end] if found[end] is None else [end, found[end][0]]):
                        rows.append((place, shard, side, _END, host, *pages[p][1:], None, [int(first and last)]))
            yield _batch(rows)

        for batch in batches:
            hashes, sizes = batch.column("hashes"), batch.column("sizes")
            for i, (key, own) in enumerate(zip(batch.column("key").to_pylist(), batch.column("host").to_pylist())):
                if own != host and pages:
                    yield from settled(False)
                    pages, first = [], False
                host = own
                pages.append((key, hashes[i].values.to_numpy(), sizes[i].values.to_numpy()))
        if pages:
            yield from settled(True)

    some = signatures.where(F.size("hashes") > 0).select("host", "path", "key", "hashes", "sizes")
    ordered = some.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    return materialized(ordered.mapInArrow(run, _FOUND), "html-mates")


def _beyond(ends: list) -> dict[tuple[int, int], tuple[str, list[np.ndarray]]]:
    """By range and side, the host and the pages to compare with across that end, nearest first."""
    shards: dict[tuple[int, int], list] = {}
    for row in ends:
        shards.setdefault((row["shard"], row["side"]), []).append(row)
    out = {}
    numbers = sorted({shard for shard, _ in shards})
    for side, order in enumerate((numbers, numbers[::-1])):
        host, near = None, []
        for shard in order:
            if host is not None:
                out[shard, side] = host, [hashes for hashes, _ in near]
            own = sorted(shards[shard, side], key=lambda r: r["key"])
            pages = [(np.array(r["hashes"], np.int64), np.array(r["sizes"], np.int64)) for r in own]
            # a range of one host that has only copies is looked through
            if len(pages) == 1 and own[0]["inner"] == [1] and own[0]["host"] == host:
                pages += [p for p in near if _differing(*pages[0], p[0]) is not None][:1]
            host, near = own[0]["host"], pages
    return out


def _deleted(signatures: DataFrame) -> DataFrame:
    """(key, gone): places of the lines that are not the page's own."""
    found = _compared(signatures)
    # at most four rows for each range
    beyond = _beyond(found.where(F.col("kind") == _END).collect())
    shared = found.sparkSession.sparkContext.broadcast(beyond)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                host, near = shared.value.get((r["shard"], r["side"]), (None, []))
                if host != r["host"]:
                    continue
                hashes, sizes = np.array(r["hashes"], np.int64), np.array(r["sizes"], np.int64)
                for theirs in near:
                    places = _differing(hashes, sizes, theirs)
                    if places is not None:
                        rows.append(_shared_row(r["key"], sizes, places))
                        break
            yield _batch(rows)

    joined = found.where(F.col("kind") == _SHARED).union(found.where(F.col("kind") == _OPEN).mapInArrow(across, _FOUND))
    lists = joined.groupBy("key").agg(F.flatten(F.collect_list("outer")).alias("outer"), F.collect_list("inner").alias("inner"))
    every = F.array_intersect(F.col("inner")[0], F.element_at("inner", -1))  # one list or two
    return lists.select("key", F.array_union("outer", every).alias("gone")).where(F.size("gone") > 0)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``."""
    keyed = _keyed(pages)
    found = _signatures(keyed)
    place = F.regexp_replace(F.coalesce("url", F.lit("")), "^[^/]*://", "")
    host, path = F.lower(F.substring_index(place, "/", 1)), F.regexp_replace(F.regexp_replace(place, "^[^/]*/?", ""), "[?#].*$", "")
    # equal rows are one page here
    found = found.select("key", host.alias("host"), path.alias("path"), "hashes", "sizes").dropDuplicates(["key"])
    gone = _deleted(_with_common(materialized(found, "html-lines")))
    kind = T.StructType([T.StructField("lines", T.ArrayType(T.StringType()))])
    texts = with_columns_by_batch(
        keyed, "html", kind, lambda column: [[lines_of(page)[0] for page in column.to_pylist()]], keep=["page_id", "url", "key"]
    )
    joined = texts.join(gone, "key", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    text = F.array_join(kept, "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
