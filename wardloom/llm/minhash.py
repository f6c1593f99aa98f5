"""Near-duplicate classes by circulant MinHash, verified on full shingle sets.

A document's set holds its distinct runs of ``WORDS`` words; with fewer words,
the whole sequence is its only element; without words the set is empty and
linked with nothing. Two documents are linked if 100 * |A and B| >= 75 * |A or B|,
and a component is what links reach.

1. *Sketch.* A first permutation sends each shingle to one of ``UNIVERSE``
   places; a second one, circularly shifted by 1, 2, ... places, gives all
   ``BANDS * ROWS`` signature coordinates: coordinate k is the smallest value
   of the second permutation over the set's places + k. ``BANDS`` bands of
   ``ROWS`` coordinates are the bucket keys (a pair at 0.75 shares none with
   probability 5e-6).
2. *Classes.* Documents with equal sets are one class, led by the smallest
   doc_id, before anything else is done with them.
3. *Peeling.* The member of a bucket that meets most others, in all its
   buckets, is the hub and is compared with all members that are not yet in
   its component; then the hub leaves the bucket. A bucket whose members are in one component is finished. A
   group of many near copies is thus joined by as many comparisons as it has
   members. When few pairs are open, or another round would not halve them,
   all are compared, in blocks of bounded size.
   No pair of a bucket is left out unless its two documents are in one
   component already or differ too much in size, so the result is exact for
   all candidate pairs, whatever a bucket's size.
4. *Links* are confirmed on the full sets, by batches of joined pairs;
   components are found by pointer jumping over tables of labels.

Defined cases: a null or empty text has an empty set, is its own component
and is kept; rows that share a doc_id are one node; a null doc_id has a null
component and is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import byte_texts, pieces, with_columns_by_batch
from wardloom.sources.sinks import materialized

WORDS = 5
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
PERCENT = 75
# All that is open is compared at once when it is at most so many pairs per class.
OPEN_PAIRS = 8
BLOCK = 256

_rng = np.random.default_rng(20_240_607)
_ODD = _rng.integers(0, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_SIGMA = _rng.integers(0, 1 << 63, 1, np.uint64)[0]
_pi: np.ndarray | None = None


def _shifted() -> np.ndarray:
    """Row p: the second permutation at places p, p + 1, ..., circularly."""
    global _pi
    if _pi is None:
        order = np.random.default_rng(7).permutation(UNIVERSE).astype(np.uint32)
        around = np.concatenate([order, order[: BANDS * ROWS - 1]])
        _pi = np.lib.stride_tricks.sliding_window_view(around, BANDS * ROWS)
    return _pi


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    hashes = _WordHashes()
    out = []
    for text in texts:
        split = text.lower().split()
        n = len(split)
        own = np.fromiter(map(hashes.__getitem__, split), np.uint64, n)
        if n >= words:
            total = np.zeros(n - words + 1, np.uint64)
            for k in range(words):
                total += own[k : n - words + 1 + k] * _ODD[k]
        else:  # told apart from full shingles by the number of words
            total = (own * _ODD[:n]).sum(dtype=np.uint64, keepdims=True)[: min(n, 1)] + np.uint64(n) * _ODD[-1]
        found = _mixed(total)
        found.sort()
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if n else found)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    places = (_mixed(shingles ^ _SIGMA) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    table, least = _shifted(), None
    for i in range(0, len(places), 4096):
        part = table[places[i : i + 4096]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[0]
    for k in range(ROWS):
        keys = _mixed(keys + (rows[:, k] + np.uint64(1)) * _ODD[k + 1])
    return keys.view(np.int64)


def _sketched(texts: pa.Array) -> list:
    sizes, digests, bands = [], [], []
    for shingles in shingle_sets(byte_texts(texts)):
        sizes.append(len(shingles))
        full = len(shingles) > 0
        digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if full else None)
        bands.append(band_keys(signature(shingles)) if full else None)
    return [sizes, digests, bands]


SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and band keys (both null for an empty set)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_columns_by_batch(source, "text", SKETCH, _sketched, keep=["doc_id"])


def _candidates(classes: DataFrame) -> DataFrame:
    """(key, id, n) of every bucket with at least two classes."""
    rows = classes.select(F.explode("bands").alias("key"), F.col("id"), F.col("n"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key")
    return materialized(rows.join(shared, "key"), "minhash-members")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, shingles) of the classes that share a bucket, from their leaders' texts."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(nodes, "id")
    kind = T.StructType([T.StructField("shingles", T.BinaryType()), T.StructField("own", T.BinaryType())])

    def compute(texts: pa.Array) -> list:
        sets = [s.tobytes() for s in shingle_sets(byte_texts(texts))]
        return [sets, [hashlib.blake2b(s, digest_size=16).digest() for s in sets]]

    found = with_columns_by_batch(source, "text", kind, compute, keep=["id", "digest"])
    return materialized(found.where("own = digest").select("id", "shingles"), "minhash-sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                one = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                two = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialized(joined.mapInArrow(run, "a long, b long"), "minhash-links")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that it reaches."""
    labels = None
    edges = materialized(edges.select("a", "b").where("a <> b"), "components-edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        up = materialized(up, "components-up")
        while True:  # follow the pointers to their ends
            next_up = up.toDF("root", "next")
            step = materialized(
                up.join(next_up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
                "components-up",
            )
            up = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            labels = materialized(
                labels.join(up.toDF("root", "_next"), "root", "left").select("node", F.coalesce("_next", "root").alias("root")),
                "components-labels",
            )
        edges = materialized(
            edges.join(up.toDF("a", "_a"), "a").join(up.toDF("b", "_b"), "b")
            .where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(),
            "components-edges",
        )
    return labels if labels is not None else edges.toDF("node", "root")


def _similar_size(a: str, b: str) -> F.Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs of a hub and a member of its bucket in another component."""
    pairs = members.where("comp <> hub_comp").where(_similar_size("n", "hub_n"))
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _met(members: DataFrame) -> DataFrame:
    """(hub_comp, id, comp, outside): who is in a bucket led from which component."""
    return members.select("hub_comp", "id", "comp").distinct().withColumn("outside", F.col("comp") != F.col("hub_comp"))


def _work(met: DataFrame) -> int:
    """Comparisons that are left if all of them are made."""
    sizes = met.groupBy("hub_comp").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("outside").cast("long")).alias("outside"))
    return sizes.agg(F.coalesce(F.sum(F.col("all") * F.col("outside")), F.lit(0)).alias("n")).first()["n"]


def _rest_linked(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between those outside a leading component and all it was met with, block by block.

    Both sides are cut into blocks of a bounded size, and each pair of blocks
    is one group, which yields links only.
    """
    sizes = met.groupBy("hub_comp").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all_blocks"),
        F.ceil(F.sum(F.col("outside").cast("long")) / BLOCK).cast("int").alias("out_blocks"),
    ).where("out_blocks > 0")
    rows = met.join(sizes, "hub_comp").join(sets, "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["hub_comp", "id", "comp", "shingles"]
    every = rows.select(*kept, F.lit(False).alias("asks"), block("all_blocks").alias("x"), upto("out_blocks").alias("y"))
    asking = rows.where("outside").select(*kept, F.lit(True).alias("asks"), upto("all_blocks").alias("x"), block("out_blocks").alias("y"))

    def run(group: pa.Table) -> pa.Table:
        ids, comps, asks = (group.column(c).to_numpy() for c in ("id", "comp", "asks"))
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        there, here = np.flatnonzero(~asks), np.flatnonzero(asks)
        found: list[tuple[int, int]] = []
        if len(there):
            length = np.array([len(sets[i]) for i in there])
            flat = np.concatenate([sets[i] for i in there])
            owner = np.repeat(np.arange(len(there)), length)
            for i in here.tolist():
                own = sets[i]
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.bincount(owner[own[place] == flat], minlength=len(there))
                good = (100 * both >= PERCENT * (length + len(own) - both)) & (comps[there] != comps[i])
                found += [(min(ids[i], x), max(ids[i], x)) for x in ids[there[good]]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialized(every.union(asking).groupBy("hub_comp", "x", "y").applyInArrow(run, "a long, b long"), "minhash-links")


def _components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, comp) of the classes that have links."""
    members = _candidates(classes)
    nodes = members.select("id").distinct().join(classes.select("id", "digest"), "id")
    sets = _full_sets(docs, nodes)
    members = members.withColumn("comp", F.col("id"))
    labels = None
    size, work = classes.count(), None
    while True:
        # what is still open: buckets whose members are in several components
        several = members.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("m")).where("_lo <> _hi")
        members = materialized(members.join(several.select("key", "m"), "key"), "minhash-members")
        # the original of a group of copies meets more of them than the copies meet each other
        central = members.groupBy("id").agg(F.sum("m").alias("meets"))
        best = F.max(F.struct("meets", (-F.col("id")).alias("order"), "n", "comp")).alias("best")
        hubs = materialized(
            members.drop("m").join(central, "id").groupBy("key").agg(best, F.count(F.lit(1)).alias("m"))
            .select("key", "m", (-F.col("best.order")).alias("hub"), F.col("best.n").alias("hub_n"), F.col("best.comp").alias("hub_comp")),
            "minhash-hubs",
        )
        if hubs.isEmpty():
            break
        members = members.drop("m").join(hubs.drop("m"), "key")
        met = materialized(_met(members), "minhash-met")
        work, before = _work(met), work
        # once a round of hubs has been compared, what is left is either little or not to be had by more rounds
        last = before is not None and (work <= OPEN_PAIRS * size or 2 * work > before)
        links = _rest_linked(met, sets) if last else _linked(_hub_pairs(members), sets)
        members = members.where("id <> hub").select("key", "id", "n", "comp")
        # links join components, so they are joined by their labels
        ends = links
        if labels is not None:
            for side in ("a", "b"):
                ends = ends.join(labels.toDF(side, f"_{side}"), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
        roots = connected(ends)
        if labels is None:
            labels = roots
        else:
            named = labels.toDF("node", "_old").join(roots.toDF("_old", "_new"), "_old", "left")
            fresh_nodes = roots.join(labels.select("node"), "node", "left_anti")
            labels = materialized(
                named.select("node", F.coalesce("_new", "_old").alias("root")).union(fresh_nodes.select("node", "root")), "minhash-labels"
            )
        if last:
            break
        members = materialized(
            members.drop("comp").join(labels.toDF("id", "_root"), "id", "left").select("key", "id", "n", F.coalesce("_root", "id").alias("comp")),
            "minhash-members",
        )
    if labels is None:
        return members.select("id", F.col("id").alias("comp")).limit(0)
    return labels.toDF("id", "comp")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    known = materialized(sketches(docs), "minhash-sketches")
    classes = (
        known.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    )
    classes = materialized(classes, "minhash-classes")
    comps = _components(docs, classes)
    # a doc_id with several texts is one node: its classes are linked through it
    led = classes.select("digest", "id").join(comps, "id", "left").select("digest", F.coalesce("comp", "id").alias("_comp"))
    out = known.select("doc_id", "n_shingles", "digest").join(led, "digest", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("_comp", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component."""
    found = components(docs)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == F.col("_dropped"), "left_anti")
