"""Benchmark decontamination with suffix arrays over the training text.

A task reads its documents in shards of a few megabytes and sorts, for each
shard, the suffixes (by word) in a suffix array. Every suffix of every
benchmark item is binary-searched in it: the range of suffixes that begin with
a whole window of the item gives each place where that window occurs, and all
of the range are extended, so that each document has its own longest verbatim
match, whatever else is in its shard. Where a document has no whole window but
items are shorter, its suffixes are searched in the sorted benchmark instead.

A *window* is ``WINDOW`` consecutive words of an item, or the whole item if
it has fewer. Suffixes that cannot start a match as long as the shortest
window (a word too soon that no item has) are left out of the array, which
changes no result. Words are compared as such, not by hash.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text, its
size having been checked; each block goes over all documents, and nothing of
the documents is shuffled. A benchmark of one block needs no shuffle at all.

Defined cases: a null or empty text has no words and is never hit; an item
without words has no windows; an item with a null id is left out; repeated
documents each give their own row; repeated items (same id) count once; empty
tables give an empty or unhit result; other columns are carried along or
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import byte_texts, fresh, with_columns_by_batch

WINDOW = 13
BLOCK_BYTES = 32 << 20
# A document is contaminated if at least 1 in this many of its words are hit.
SHARE = 20
SHARD_WORDS = 500_000
PIECE = 1 << 16

# A-Z become a-z; other ASCII characters than digits and letters become spaces.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
    T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.IntegerType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_at", T.IntegerType()),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass
class Benchmark:
    """The suffixes of one block of items, as rows of word ids."""

    word_ids: dict[bytes, int]  # from 1
    items: list[str]
    suffixes: np.ndarray  # (n, WINDOW) word ids, 0 behind the item's end
    suffix_item: np.ndarray
    tail: list[np.ndarray]  # all word ids of each item
    suffix_at: np.ndarray  # position in the item
    windows: dict[int, tuple[np.ndarray, list[list[int]]]]  # length -> distinct windows, their items
    shortest: int


def index_items(rows: Sequence[tuple[str, bytes]], window: int = WINDOW) -> Benchmark:
    word_ids: dict[bytes, int] = {}
    items, tails, suffixes, owner, position = [], [], [], [], []
    grouped: dict[int, dict[tuple, set[int]]] = {}
    for item, text in sorted(set(rows)):
        ids = [word_ids.setdefault(w, len(word_ids) + 1) for w in words_of(text)]
        if not ids:
            continue
        number = len(items)
        items.append(item)
        tails.append(np.array(ids, np.int32))
        padded = np.array(ids + [0] * window, np.int32)
        suffixes.append(np.lib.stride_tricks.sliding_window_view(padded, window)[: len(ids)])
        owner += [number] * len(ids)
        position += range(len(ids))
        length = min(window, len(ids))
        own = grouped.setdefault(length, {})
        for i in range(len(ids) - length + 1):
            own.setdefault(tuple(ids[i : i + length]), set()).add(number)
    windows = {n: (np.array(list(own), np.int32), [sorted(s) for s in own.values()]) for n, own in grouped.items()}
    return Benchmark(
        word_ids, items, np.concatenate(suffixes) if suffixes else np.zeros((0, window), np.int32),
        np.array(owner, np.int64), tails, np.array(position, np.int64), windows, min(windows, default=window),
    )


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort like the rows."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{rows.shape[1] * 4}").ravel()


class Shard:
    """Suffix array over the words of some documents, end to end.

    A document's end is a word of its own (0), and so is every word that no
    item has, so that no match runs over it.
    """

    def __init__(self, texts: Sequence[list[bytes]], bench: Benchmark, window: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        known = bench.word_ids.get
        flat: list[int] = []
        for text in texts:
            flat.extend(map(known, text, repeat(0)))
            flat.append(0)
        self.ids = np.array(flat + [0] * window, np.int32)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = len(self.ids)
        gaps = np.flatnonzero(self.ids == 0)
        runs = gaps[np.searchsorted(gaps, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)
        kept = np.flatnonzero(runs >= bench.shortest)
        rows = np.lib.stride_tricks.sliding_window_view(self.ids, window)[kept]
        # behind the first word that cannot match, what follows is of no interest
        rows = np.where(np.arange(window) < runs[kept][:, None], rows, 0)
        keys = _keys(rows) if len(kept) else np.zeros(0, f"S{4 * window}")
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys, self.window = kept[order], keys[order], window

    def occurrences(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last place in the suffix array of those that begin with each window."""
        width = windows.shape[1]
        low = np.zeros((len(windows), self.window), np.int64)
        low[:, :width] = windows
        high = np.full((len(windows), self.window), 0xFFFFFFFF, np.int64)
        high[:, :width] = windows
        return np.searchsorted(self.keys, _keys(low)), np.searchsorted(self.keys, _keys(high), side="right")

    def longest(self, bench: Benchmark) -> list[tuple[int, int, int, int]]:
        """For each document with a match: length, suffix of the benchmark, place; the longest, then the first."""
        if not len(self.suffixes) or not len(bench.suffixes):
            return []
        best = self._whole_windows(bench)
        if bench.shortest < self.window:
            best |= self._below_window(bench, best)
        return [(d, -n, s, a) for d, (n, s, a) in best.items()]

    def _whole_windows(self, bench: Benchmark) -> dict[int, tuple[int, int, int]]:
        """Longest matches of the documents that have a whole window.

        Every pair of suffixes equal on the window is extended, but those that
        go on to the left, as they are part of a longer match.
        """
        asked = np.flatnonzero((bench.suffixes > 0).all(axis=1))
        low, high = self.occurrences(bench.suffixes[asked])
        best: dict[int, tuple[int, int, int]] = {}
        for number in np.flatnonzero(high > low).tolist():
            s = int(asked[number])
            item, first = bench.tail[bench.suffix_item[s]], int(bench.suffix_at[s])
            at = self.suffixes[low[number] : high[number]]
            if first:
                at = at[(at == 0) | (self.ids[at - 1] != item[first - 1])]
            lengths = np.full(len(at), self.window, np.int64)
            going, done = np.arange(len(at)), self.window
            while len(going) and first + done < len(item):
                part = item[first + done : first + done + max(1, min(done, (1 << 20) // len(going)))]
                ahead = np.minimum((at[going] + done)[:, None] + np.arange(len(part)), len(self.ids) - 1)
                same = self.ids[ahead] == part
                whole = same.all(axis=1)
                lengths[going] += np.where(whole, len(part), np.argmin(same, axis=1))
                going, done = going[whole], done + len(part)
            docs = np.searchsorted(self.begins, at, side="right") - 1
            for a, n, d in zip(at.tolist(), lengths.tolist(), docs.tolist()):
                found = (-n, s, a - int(self.begins[d]))
                if d not in best or found < best[d]:
                    best[d] = found
        return best

    def _below_window(self, bench: Benchmark, known: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """Longest matches of the other documents: each of their suffixes between its neighbours in the benchmark."""
        docs = np.searchsorted(self.begins, self.suffixes, side="right") - 1
        some = np.flatnonzero(~np.isin(docs, np.fromiter(known, np.int64, len(known))))
        order = np.argsort(_keys(bench.suffixes), kind="stable")
        keys = _keys(bench.suffixes[order])
        docs, at = docs[some], self.suffixes[some]
        place = np.searchsorted(keys, self.keys[some])
        lengths = np.zeros(len(some), np.int64)
        for shift in (0, -1):
            near = np.clip(place + shift, 0, len(order) - 1)
            for i in range(0, len(some), PIECE):
                theirs = bench.suffixes[order[near[i : i + PIECE]]]
                mine = self.ids[at[i : i + PIECE][:, None] + np.arange(self.window)]
                same = (mine == theirs) & (mine > 0)
                longer = np.where(same.all(axis=1), self.window, np.argmin(same, axis=1))
                lengths[i : i + PIECE] = np.maximum(lengths[i : i + PIECE], longer)
        most = np.zeros(len(self.begins), np.int64)
        np.maximum.at(most, docs, lengths)
        top = np.flatnonzero((lengths == most[docs]) & (lengths >= bench.shortest))
        # of equally long ones the first suffix of the benchmark that begins so
        kept = np.arange(self.window) < lengths[top][:, None]
        rows = self.ids[at[top][:, None] + np.arange(self.window)]
        low = np.searchsorted(keys, _keys(np.where(kept, rows, 0).astype(np.int64)))
        high = np.searchsorted(keys, _keys(np.where(kept, rows, 0xFFFFFFFF).astype(np.int64)), side="right")
        first: dict[tuple[int, int], int] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for i, b, e in zip(top.tolist(), low.tolist(), high.tolist()):
            if (b, e) not in first:
                first[b, e] = int(order[b:e].min())
            d = int(docs[i])
            found = (-int(lengths[i]), first[b, e], int(at[i] - self.begins[d]))
            if d not in best or found < best[d]:
                best[d] = found
        return best

    def hits(self, bench: Benchmark) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are inside an occurrence of a window, and each document's items."""
        change = np.zeros(len(self.ids) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for length, (windows, owners) in bench.windows.items():
            low, high = self.occurrences(windows)
            for w in np.flatnonzero(high > low).tolist():
                at = self.suffixes[low[w] : high[w]]
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
                for d in np.unique(np.searchsorted(self.begins, at, side="right") - 1).tolist():
                    items.setdefault(d, set()).update(owners[w])
        return np.cumsum(change[:-1]) > 0, items


def _matched(bench: Benchmark, texts: list[bytes], window: int) -> list[list]:
    split = [words_of(t) for t in texts]
    out: list[list] = [[] for _ in FIELDS.fields]
    start = 0
    while start < len(split):
        stop, held = start, 0
        while stop < len(split) and (held == 0 or held + len(split[stop]) <= SHARD_WORDS):
            held += len(split[stop])
            stop += 1
        shard = Shard(split[start:stop], bench, window)
        hit, items = shard.hits(bench)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        firsts, lasts = edges[::2], edges[1::2]
        docs = np.searchsorted(shard.begins, firsts, side="right") - 1
        longest = {d: rest for d, *rest in shard.longest(bench)}
        bounds = np.searchsorted(docs, np.arange(stop - start + 1))
        for d in range(stop - start):
            own = slice(bounds[d], bounds[d + 1])
            n, s, a = longest.get(d, (0, None, None))
            row = (
                int(shard.sizes[d]), (firsts[own] - shard.begins[d]).tolist(), (lasts[own] - shard.begins[d]).tolist(),
                sorted({bench.items[i] for i in items.get(d, ())}), n,
                None if s is None else bench.items[bench.suffix_item[s]], a,
            )
            for column, value in zip(out, row):
                column.append(value)
        start = stop
    return out


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Distinct rows of the benchmark in blocks of a checked size, by a hash of the row.

    Where a block would be larger than ``block_bytes`` there are more blocks,
    until each is within it or is one row, which is needed as a whole.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    size = F.octet_length("text") + F.octet_length("item")
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)

    def block_of(n: int) -> Column:
        return F.pmod(F.xxhash64("item", "text"), F.lit(n))

    while blocks > 1:
        held = items.groupBy(block_of(blocks).alias("b")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
        if held.where((F.col("bytes") > block_bytes) & (F.col("rows") > 1)).isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        chosen = items if blocks == 1 else items.where(block_of(blocks) == b)
        yield sorted((r["item"], r["text"].encode()) for r in chosen.collect())


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with what of the benchmark each text has.

    Added, under names that ``docs`` does not have: ``n_words``; ``hit_starts``
    and ``hit_ends``, the runs of words inside occurrences of windows;
    ``items``, sorted; and the longest verbatim match: ``longest`` (words, 0 if
    below the shortest window), ``longest_item``, ``longest_at``.
    """
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    names = [fresh([*keep, "text"], f.name) for f in FIELDS.fields]
    fields = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, FIELDS.fields)])
    parts = []
    row = fresh([*docs.columns, *names], "row")
    blocks = _item_blocks(benchmark, block_bytes)
    held = next(blocks)
    while held is not None:
        following = next(blocks, None)
        many = following is not None or parts
        shared = spark.sparkContext.broadcast(index_items(held, window))
        own = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]
        # 128 bits tell the rows apart
        source = docs.withColumn(row, F.concat_ws(" ", F.xxhash64(*own).cast("string"), F.xxhash64(F.lit(row), *own).cast("string"))) if many else docs
        parts.append(with_columns_by_batch(
            source, "text", fields, lambda texts, b=shared: _matched(b.value, byte_texts(texts), window),
            [*keep, row] if many else keep,
        ))
        held = following
    if len(parts) == 1:
        return parts[0]
    return _joined(parts, row, keep, names)


def _joined(parts: list[DataFrame], row: str, keep: list[str], names: list[str]) -> DataFrame:
    """One row for each document from its rows of all blocks; equal documents are told apart by number."""
    n_words, starts, ends, items, longest, longest_item, longest_at = names
    every = parts[0].withColumn("_block", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_block", F.lit(i)))
    spans = F.flatten(F.collect_list(F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b"))))
    merged = every.groupBy(row).agg(
        *[F.first(f"`{c}`").alias(c) for c in keep],
        F.first(n_words).alias(n_words),
        F.array_sort(F.array_distinct(spans)).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
        F.max(F.struct(F.col(longest), (-F.col("_block")).alias("_order"), F.col(longest_item), F.col(longest_at))).alias("_best"),
        F.sum(F.when(F.col("_block") == 0, 1).otherwise(0)).alias("_copies"),
    )
    # overlapping and touching runs become one
    joined = F.aggregate(
        "_spans", F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(
                    F.try_element_at(acc, F.lit(-1))["a"].alias("a"),
                    F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["b"]).alias("b"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))),
    )
    return (
        merged.withColumn("_joined", joined)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(
            *[F.col(f"`{c}`") for c in keep], n_words, F.transform("_joined", lambda x: x["a"]).alias(starts),
            F.transform("_joined", lambda x: x["b"]).alias(ends), items, F.col(f"_best.{longest}").alias(longest),
            F.col(f"_best.{longest_item}").alias(longest_item), F.col(f"_best.{longest_at}").alias(longest_at),
        )
    )


def _hit_words(starts: str, ends: str) -> F.Column:
    sizes = F.zip_with(F.col(starts), F.col(ends), lambda a, b: (b - a).cast("long"))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match of each document."""
    found = matches(docs.select("doc_id", "text"), benchmark, keep=["doc_id"], **options)
    n_hit = _hit_words("hit_starts", "hit_ends")
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "longest", "longest_item", "longest_at",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    found = matches(docs, benchmark, **options)
    n_words, starts, ends = found.columns[len(docs.columns) :][:3]
    hit = _hit_words(f"`{starts}`", f"`{ends}`")
    kept = found.where((hit == 0) | (SHARE * hit < F.col(f"`{n_words}`")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

