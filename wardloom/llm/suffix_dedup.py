"""Remove repeated byte strings by a hash-compared suffix sort.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier: in a document with a smaller doc_id, or before it in the same one.
Strings never cross documents and are judged on the texts as given.

1. *Anchors.* Among the ``GRAM``-byte grams in a string, the one with the
   smallest hash (the leftmost on a tie) is its anchor. Equal strings have
   equal anchors at equal places, so only strings with the same anchor need
   to be compared. Strings in a row that share one anchor are a segment; about
   one byte in 35 is an anchor.
2. *Whole segments.* Records of segments meet by anchor. Of those whose bytes
   are equal from end to end, all but the first are repeats at once. What has
   only one such context is finished; the rest must be sorted. Each task keeps
   only the first of its own equal segments, so that a passage which a third of
   all documents share is a few rows for each task.
3. *Suffix sort.* The bytes of the rest are gathered by anchor and the suffixes
   that start at the anchors are mergesorted. A comparison finds the common
   extension by binary search over prefix polynomial hashes, so it takes a
   logarithmic number of steps. Neighbours' common extensions to the right and
   polynomial hashes to the left then give the classes of equal strings, which
   are verified byte by byte. The first of each class stays.
4. *Spans* are gathered for each document and cut out.

An anchor with over ``MANY`` contexts is dealt out by the strings themselves,
each task again keeping only the first of its own equal strings.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` are never
touched; a null doc_id counts as the smallest; rows that share a doc_id (or have
none) are the same document if their texts are equal, else each is its own, in
order of a hash of the text; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import byte_texts, document_keys, id_of_keys, pieces
from wardloom.sources.sinks import materialized

LENGTH = 100
GRAM = 32
MANY = 2000
HASH_BYTES = 1 << 19  # texts are hashed in runs of about this many bytes
HELD_RECORDS = 1 << 19
SORT_SEGMENTS = 1 << 15

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Bytes with their prefix polynomial hashes modulo 2 ** 64."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        if len(_powers[0]) < n + 1:
            for i, base in enumerate((_BASE, _INVERSE)):
                grown = np.full(max(n + 1, 1 << 20), base, np.uint64)
                grown[0] = 1
                _powers[i] = np.multiply.accumulate(grown)
        self.inverse = _powers[1]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=self.prefix[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]

    def every(self, length: int) -> np.ndarray:
        n = max(len(self.bytes) - length + 1, 0)
        return (self.prefix[length : length + n] - self.prefix[:n]) * self.inverse[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value, the leftmost on a tie, in every window."""
    least, place, reach = values, np.arange(len(values), dtype=np.int32), 1
    while reach < width:
        step = min(reach, width - reach)
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])
        reach += step
    return place


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts end to end: text number, first start in it, number of starts,
    bytes from the first start to the anchor, hash of the anchor, hash of all bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = Hashed(b"".join(texts))
    n = len(data.bytes)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    ends = np.cumsum(sizes)
    grams = _mixed(data.every(GRAM))
    # grams that cross an end are nobody's anchor, and neither are strings that do
    remaining = np.repeat(ends, sizes) - np.arange(n)
    grams[remaining[: len(grams)] < GRAM] = np.uint64(0xFFFFFFFFFFFFFFFF)
    place = _least(grams, LENGTH - GRAM + 1)
    good = remaining[: len(place)] >= LENGTH
    starts = np.flatnonzero(good)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    anchor = place[starts]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    at = anchor[first].astype(np.int64)
    text = np.searchsorted(ends, begin, side="right")
    context = _mixed(data.at(begin, count - 1 + LENGTH) + (count * 128 + at - begin).astype(np.uint64))
    return text, begin - (ends - sizes)[text], count, at - begin, grams[at], context


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join runs of starts that touch, in order of document and start."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    if not len(doc):
        return doc, start, count
    stop = start + count
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first) - start[first]


def _firsts(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the row of its key that comes first; and whether it is another place than that."""
    order = np.lexsort((start, doc, key))
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])[: len(key)]
    leader = np.empty(len(key), np.int64)
    leader[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return leader, (doc != doc[leader]) | (start != start[leader])


def _ranked(doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """One number for each document, in order of doc and part, and what turns numbers back into both."""
    if not part.any():
        return doc, lambda rank: (rank, np.zeros(len(rank), np.int64))
    order = np.lexsort((part, doc))
    new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(part[order]) != 0)])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    docs, parts = doc[order[new]], part[order[new]]
    return rank, lambda some: (docs[some], parts[some])


RECORD = "anchor long, context long, doc long, part long, start long, shape int, done boolean"
_RECORD_NAMES = ["anchor", "context", "doc", "part", "start", "shape", "done"]


def _records(docs: DataFrame) -> DataFrame:
    """Segments of all documents; ``shape`` has the number of starts and the anchor's place."""

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        doc, part, start, count, offset, anchor, context = (np.concatenate(x) for x in zip(*parts))
        doc, back = _ranked(doc, part)
        leader, later = _firsts(_mixed(anchor + context * np.uint64(_BASE)), doc, start)
        later &= (anchor == anchor[leader]) & (context == context[leader])
        d, s, c = _runs(doc[later], start[later], count[later])
        keep = leader == np.arange(len(leader))
        columns = [
            np.concatenate([anchor[keep].view(np.int64), (_mixed(back(d)[0].view(np.uint64) + s.view(np.uint64))).view(np.int64)]),
            np.concatenate([context[keep].view(np.int64), np.zeros(len(d), np.int64)]),
            *back(np.concatenate([doc[keep], d])), np.concatenate([start[keep], s]),
            np.concatenate([count[keep] * 128 + offset[keep], c]).astype(np.int32),
            np.concatenate([np.zeros(keep.sum(), bool), np.ones(len(d), bool)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_RECORD_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch, "text", HASH_BYTES):
                ids = np.array(piece.column("doc").to_pylist(), np.int64)
                own = np.array(piece.column("part").to_pylist(), np.int64)
                text, start, count, offset, anchor, context = segments(byte_texts(piece.column("text")))
                parts.append((ids[text], own[text], start, count, offset, anchor, context))
                held += len(text)
                if held >= HELD_RECORDS:
                    yield settled(parts)
                    parts, held = [], 0
        if held:
            yield settled(parts)

    return docs.mapInArrow(run, RECORD)


def _met(records: DataFrame) -> DataFrame:
    """Repeats (``anchor`` null) and segments still to be sorted, from records that meet by anchor.

    Rows come sorted, so a group is followed without holding more than a batch and ``MANY`` of its contexts:
    those of a longer one are passed on as they come.
    """
    names = ["doc", "part", "start", "count", "offset", "anchor", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, passed = None, 0  # contexts of the open group that are passed on, or enough of them

        def settle(rows: dict[str, np.ndarray], before: int) -> Iterator[pa.RecordBatch]:
            anchor, context = rows["anchor"], rows["context"]
            n = len(anchor)
            done = rows["done"]
            new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])[:n]
            new_context = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])[:n]
            group = np.cumsum(new_anchor) - 1
            leader = np.flatnonzero(new_context)[np.cumsum(new_context) - 1]
            later = ~done & np.any([rows[c] != rows[c][leader] for c in ("doc", "part", "start")], axis=0)
            contexts = np.bincount(group[new_context & ~done], minlength=group[-1] + 1 if n else 0)
            contexts[:1] += before
            several = (contexts[group] > 1) & new_context & ~done
            many = contexts[group] > MANY
            doc, part = (np.concatenate([rows[c][done], rows[c][later], rows[c][several]]) for c in ("doc", "part"))
            shape = rows["shape"]
            count = np.concatenate([shape[done], shape[later] // 128, shape[several] // 128])
            k = int(done.sum() + later.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(doc), pa.array(part), pa.array(np.concatenate([rows["start"][done], rows["start"][later], rows["start"][several]])),
                pa.array(count.astype(np.int32)), pa.array(np.concatenate([np.zeros(k, np.int32), shape[several] % 128]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(k, np.int64), anchor[several]]), mask=np.arange(len(doc)) < k),
                pa.array(np.concatenate([np.zeros(k, bool), many[several]])),
            ], names=names)

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _RECORD_NAMES}
            if tail is not None:
                rows = {c: np.concatenate([tail[c], v]) for c, v in rows.items()}
            if not len(rows["anchor"]):
                continue
            cut = int(np.searchsorted(rows["anchor"], rows["anchor"][-1]))  # the last group may go on
            if cut:
                yield from settle({c: v[:cut] for c, v in rows.items()}, passed)
                passed = 0
            tail = {c: v[cut:] for c, v in rows.items()}
            starts = np.flatnonzero(np.concatenate([[True], tail["context"][1:] != tail["context"][:-1]]))
            if passed or (~tail["done"][starts]).sum() > MANY:
                last = int(starts[-1])  # the last context may go on
                passed = MANY + 1
                if last:
                    yield from settle({c: v[:last] for c, v in tail.items()}, passed)
                    tail = {c: v[last:] for c, v in tail.items()}
        if tail is not None:
            yield from settle(tail, passed)

    ordered = records.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "part", "start")
    return ordered.mapInArrow(run, "doc long, part long, start long, count int, offset int, anchor long, many boolean")


PIECE = "key long, doc long, part long, start long, count int, offset int, bytes binary"
_PIECE_NAMES = ["key", "doc", "part", "start", "count", "offset", "bytes"]


def _with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the segments to be sorted; each string on its own where an anchor has many contexts.

    A row whose ``bytes`` are null is a repeat found on the way.
    """
    asked = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "count", "offset", "anchor", "many")).alias("asked"))
    joined = docs.join(asked, ["doc", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows: list[tuple] = []
                single: list[tuple] = []
                texts = byte_texts(piece.column("text"))
                keys = zip(piece.column("doc").to_pylist(), piece.column("part").to_pylist())
                for doc, text, asked in zip(keys, texts, piece.column("asked").to_pylist()):
                    for a in asked:
                        start, count = a["start"], a["count"]
                        if a["many"]:
                            single += [(a["anchor"], *doc, start + i, a["offset"] - i, text[start + i : start + i + LENGTH]) for i in range(count)]
                        else:
                            rows.append((a["anchor"], *doc, start, count, a["offset"], text[start : start + count - 1 + LENGTH]))
                if single:
                    first: dict[tuple, tuple] = {}
                    for x in sorted(single, key=lambda x: x[1:4]):
                        lead = first.setdefault((x[0], x[4], x[5]), x)
                        if lead is x:
                            own = hashlib.blake2b(x[5] + x[0].to_bytes(8, "little", signed=True), digest_size=8).digest()
                            rows.append((int.from_bytes(own, "little", signed=True), *x[1:4], 1, x[4], x[5]))
                        elif lead[1:4] != x[1:4]:
                            rows.append((hash(x[1:4]), *x[1:4], 1, 0, None))
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_PIECE_NAMES)

    return joined.select("doc", "part", "text", "asked").mapInArrow(run, PIECE)


class Suffixes:
    """Suffixes of segments, each from its anchor to the segment's end."""

    def __init__(self, data: Hashed, at: np.ndarray, length: np.ndarray, group: np.ndarray):
        self.data, self.at, self.length, self.group = data, at, length, group

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        a, b = self.at[x], self.at[y]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.data.at(a, middle) == self.data.at(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as x sorts before, with or after y; a prefix sorts first."""
        shared = self.common(x, y)
        ends = shared >= np.minimum(self.length[x], self.length[y])
        last = len(self.data.bytes) - 1
        one = self.data.bytes[np.minimum(self.at[x] + shared, last)].astype(np.int64)
        two = self.data.bytes[np.minimum(self.at[y] + shared, last)].astype(np.int64)
        return np.sign(np.where(ends, self.length[x] - self.length[y], one - two))

    def sorted(self) -> np.ndarray:
        """Order of the suffixes, by group: a bottom-up mergesort of all groups at once."""
        order = np.argsort(self.group, kind="stable")
        if not len(order):
            return order
        first = np.flatnonzero(np.concatenate([[True], np.diff(self.group[order]) != 0]))
        size = np.diff(np.append(first, len(order)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while width < size.max():
            moving = np.flatnonzero(count > width)
            rank = moving - begin[moving]
            run = rank // width
            left = run % 2 == 0
            low = np.minimum((run ^ 1) * width, count[moving])
            start, high = low.copy(), np.minimum(low + width, count[moving])
            while True:  # how many of the neighbouring run come before
                busy = np.flatnonzero(low < high)
                if not len(busy):
                    break
                middle = (low[busy] + high[busy]) >> 1
                sign = self.compared(order[begin[moving[busy]] + middle], order[moving[busy]])
                before = np.where(left[busy], sign < 0, sign <= 0)
                low[busy[before]] = middle[before] + 1
                high[busy[~before]] = middle[~before]
            target = begin[moving] + (run - run % 2) * width + (rank - run * width) + (low - start)
            merged = order.copy()
            merged[target] = order[moving]
            order, width = merged, width * 2
        return order


def repeated_starts(key: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of starts whose string starts earlier in another of the segments given."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = Hashed(b"".join(texts))
    base = np.cumsum(sizes) - sizes
    anchor = base + offset
    suffixes = Suffixes(data, anchor, sizes - offset, key)
    order = suffixes.sorted()
    shared = np.zeros(len(order), np.int64)
    follows = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    shared[follows] = suffixes.common(order[follows - 1], order[follows])
    docs, starts = [], []
    every = np.arange(LENGTH)
    for left in range(LENGTH - GRAM + 1):
        # strings with so many bytes before the anchor: equal if enough follows alike and what precedes is alike
        run = np.cumsum(shared < LENGTH - left)
        has = np.flatnonzero((offset[order] >= left) & (offset[order] - left < count[order]))
        own = order[has]
        if len(own) < 2:
            continue
        before = data.at(anchor[own] - left, left)
        at = start[own] + offset[own] - left
        leader, later = _firsts(_mixed(before + run[has].astype(np.uint64) * np.uint64(_BASE)), doc[own], at)
        later = np.flatnonzero(later)
        if not len(later):
            continue
        place = anchor[own] - left
        same = np.ones(len(later), bool)
        for i in range(0, len(later), 1 << 15):
            some = later[i : i + (1 << 15)]
            same[i : i + (1 << 15)] = (
                data.bytes[place[some][:, None] + every] == data.bytes[place[leader[some]][:, None] + every]
            ).all(axis=1)
        if not same.all():  # a collision: compare these strings themselves
            odd = np.isin(leader, leader[later[~same]])
            known: dict[bytes, tuple] = {}
            members = sorted(np.flatnonzero(odd).tolist(), key=lambda i: (doc[own[i]], at[i]))
            keep = []
            for i in members:
                text = data.bytes[place[i] : place[i] + LENGTH].tobytes()
                spot = known.setdefault(text, (doc[own[i]], at[i]))
                if spot != (doc[own[i]], at[i]):
                    keep.append(i)
            later = np.concatenate([later[~odd[later]], np.array(keep, np.int64)])
        docs.append(doc[own[later]])
        starts.append(at[later])
    if not docs:
        return (np.zeros(0, np.int64),) * 3
    found = np.concatenate(docs), np.concatenate(starts)
    return _runs(*found, np.ones(len(found[0]), np.int64))


def _sorted_repeats(rows: DataFrame) -> DataFrame:
    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        known = table.column("bytes").is_null().to_numpy(zero_copy_only=False)
        number = {c: table.column(c).to_numpy().astype(np.int64) for c in _PIECE_NAMES[:6]}
        number["doc"], back = _ranked(number["doc"], number.pop("part"))
        some = np.flatnonzero(~known)
        texts = [t for t in table.column("bytes").to_pylist() if t is not None]
        found = repeated_starts(*(number[c][some] for c in ("key", "doc", "start", "count", "offset")), texts) if len(some) > 1 else (np.zeros(0, np.int64),) * 3
        columns = [np.concatenate([a, number[c][known]]) for a, c in zip(found, ("doc", "start", "count"))]
        columns = [*back(columns[0]), *columns[1:]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "part", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole keys go together; rows come sorted by key
        parts: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            if held >= SORT_SEGMENTS:
                last = parts[-1].column("key")[parts[-1].num_rows - 1].as_py()
                cut = int(np.searchsorted(keys, last, side="right"))
                parts.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield settle(parts)
                    parts, held = [batch.slice(cut)], batch.num_rows - cut
            else:
                parts.append(batch)
                held += batch.num_rows
        if parts:
            yield settle(parts)

    ordered = rows.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "doc long, part long, start long, count long")


CUT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_text", T.BinaryType()), T.StructField("kept_sha256", T.StringType()),
])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, part, start, count): runs of starts of strings that also start earlier; ``docs`` has doc, part and text."""
    met = materialized(_met(_records(docs)), "suffix-met")
    wanted = met.where("anchor is not null")
    known = met.where("anchor is null").select("doc", "part", "start", F.col("count").cast("long").alias("count"))
    return known.union(_sorted_repeats(_with_bytes(docs, wanted)))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc, part, begins, ends): the bytes to remove of each document that has any, as sorted half-open runs."""
    runs = repeats(docs).groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("start", "count"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = [], []
            for row in batch.column("runs").to_pylist():
                own: list[list[int]] = []
                for r in row:
                    a, b = r["start"], r["start"] + r["count"] - 1 + LENGTH
                    if own and own[-1][1] >= a:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                begins.append([a for a, _ in own])
                ends.append([b for _, b in own])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(begins, kind), pa.array(ends, kind)], names=["doc", "part", "begins", "ends"])

    return runs.mapInArrow(run, "doc long, part long, begins array<long>, ends array<long>")


def deduplicated(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept, of every row."""
    source = document_keys(docs)
    spans = materialized(removed_spans(source), "suffix-spans")
    joined = source.join(spans, ["doc", "part"], "left").select(id_of_keys().alias("doc_id"), "text", "begins", "ends")
    names = ["doc_id", *(f.name for f in CUT.fields if texts or f.name != "kept_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), batch.column("begins").to_pylist(), batch.column("ends").to_pylist())
            for doc, text, begins, ends in zip(*columns):
                begins, ends = begins or [], ends or []
                kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)]))
                row = [doc, len(text), len(text) - len(kept), len(begins)]
                rows.append(row + [kept] * texts + [hashlib.sha256(kept).hexdigest()])
            kinds = [pa.int64()] * 4 + [pa.binary()] * texts + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [f for f in CUT.fields if f.name in names])
    return joined.mapInArrow(run, schema)
