"""Katz backoff language model over words, and scores of whole texts.

Tokens are the words of the text, lower-cased, and one end mark. The model is
a bigram model. With ``every_word`` its classes are all training words, the end
mark and one class for words that were not seen. Without, they are the *frequent*
words (``SHARE`` of all training tokens or more, at least 2, so at most 1 / SHARE
of them), the end mark and one class for all other words:

    P(w | h) = s(h) d(c) c(h, w) / C(h)       if the bigram was seen c times
             = a(h) P(w)                      otherwise
    P(w)     = (c(w) + 1/2) / (N + (F + 1) / 2)   over the F + 1 classes

and without ``every_word`` a word of the last class has a further factor
(c + 1/2) / (N' + (V' + 1) / 2) over the V' other training words and one
unseen word. d(c) is the Good-Turing discount for c up to ``CUTOFF`` and 1
above; C(h) is c(h), plus 1 if no bigram of h is discounted; a(h) is what
makes the probabilities after h sum to 1, exactly; s(h) is 1 unless every
class was seen after h.

Counts are Parquet tables partitioned by order and keyed by hash or id, and
grow with the corpus. Broadcast are only arrays of at most 1 / SHARE entries:
the frequent words, their weights as histories, and the frequent bigrams. All other
bigrams and words are looked up by one join on the n-gram; what is joined has
one row for each document and distinct n-gram, and an n-gram that occurs in a
large part of all documents is frequent, so it is not among them.

With ``every_word`` the most frequent words up to a quarter of that bound are
broadcast whatever their share. A bigram that has a word which is not frequent is keyed by a
hash of both. Its table has what it adds to log a(h) P(w), which in turn is added
up from its words: a word that is not frequent is looked up for log P(w) and
log a(w). The weights of such a history come from its own bigrams, fewer than
``SHARE`` of all tokens, gathered by one shuffle; tables that only lead to them are removed.
Its bigrams are counted and looked up in blocks: a piece of texts (about 4 MB) gives one row for each
range of keys and kind of n-gram, with its distinct sorted keys and the texts that have them, so
an n-gram is in as many rows as there are pieces that have it. A range of keys meets its table
in one group; what comes back is a sum for each text and range. Numbers of ranges and pieces follow the
input. A piece is named by its task, so rows must come in the same order when a task is run again, as from files.

Defined cases: a null or empty text is just the end mark; rows that share a
doc_id, or have none, are scored each by its own text; a null doc_id is not held
out; without training rows every probability is that of
the empty model; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardloom.llm.common import document_keys, id_of_keys, pieces, release
from wardloom.sources.sinks import discard, new_location

SHARE = 1e-6
CUTOFF = 5
HELD_KEYS = 1 << 21
SHIFT = 20
# Words are keyed by hash, with this bit set and the sign bit clear; bigram keys are below it.
WORD_BIT = 1 << 62
END = WORD_BIT
# Bigrams of two frequent words are keyed by both ids, below this bit; others by a hash with this bit set.
PAIR_BIT = 1 << 61
# Multiplier of pairs of ids; a bucket is for about so many tokens.
MIX = 0x9E3779B97F4A7C15
BUCKET_TOKENS = 1 << 21


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % WORD_BIT | WORD_BIT


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token of all texts, a number for it among the distinct ones, and tokens in each text; null is empty."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    # Arrow's own ascii_lower gives wrong texts for some slices
    words: dict[bytes, int] = {}
    place = np.array([words.setdefault(w.lower(), len(words)) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    number = place[coded.indices.to_numpy()]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    real = np.ones(len(number), bool)
    if b"" in words:  # from white space at an end of a text
        empty = words.pop(b"")
        real = number != empty
        number = number - (number > empty)
    before = np.concatenate([[0], np.cumsum(real)])
    sizes = np.diff(before[ends], prepend=0) + 1
    flat = np.full(int(sizes.sum()), -1, np.int64)
    is_word = np.ones(len(flat), bool)
    is_word[np.cumsum(sizes) - 1] = False
    flat[is_word] = number[real]
    hashes = np.fromiter(map(_hash, words), np.int64, len(words))
    return np.append(hashes, END), flat, sizes


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of each pair of hashes or ids."""
    z = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)).astype(np.int64) & (PAIR_BIT - 1) | PAIR_BIT


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys, sums of their counts, and what else goes with a key."""
    keys, counts, *others = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first), *[x[order[first]] for x in others]


def _counted(docs: DataFrame, count) -> DataFrame:
    """(key, c) over all rows; each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                keys, counts = count(piece.column("text"))
                parts.append((keys, counts))
                held += len(keys)
                if held >= HELD_KEYS:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held >= HELD_KEYS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["key", "c"])
                        parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(parts)], names=["key", "c"])

    return docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class Classes:
    """The frequent words: sorted hashes, and P(w) of each class; the last class is all other words, or with ``every_word`` the unseen ones."""

    hashes: np.ndarray
    counts: np.ndarray
    log_p: np.ndarray
    every_word: bool = False

    @property
    def bits(self) -> int:
        """Bits of an id."""
        return len(self.hashes).bit_length()

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.hashes, hashes)
        found = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes
        return np.where(found, place, len(self.hashes))


def _before(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each; a text begins after an end mark."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(sizes) - sizes] = -1
    return before


def _bigrams(hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray, classes: Classes) -> np.ndarray:
    """Key of each token's bigram by the ids of its classes."""
    ids = classes.ids(hashes)
    return ids[_before(flat, sizes)] << SHIFT | ids[flat]


@dataclass
class Weights:
    """By history: log10 of s / C and of a; discounts by count."""

    log_seen: np.ndarray
    log_back: np.ndarray
    discounts: list[float]

    def log_bigram(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10(_discounted(self.discounts, counts)) + self.log_seen[keys >> SHIFT]


def _discounted(discounts: list[float], counts: np.ndarray) -> np.ndarray:
    table = np.array([1.0, *discounts, 1.0])
    return counts * table[np.minimum(counts, len(table) - 1)]


def _discount(discounts: list[float], c: str = "c") -> Column:
    """The same of a column: the factor alone."""
    factor = F.lit(1.0)
    for r, d in enumerate(discounts, 1):
        factor = F.when(F.col(c) == r, d).otherwise(factor)
    return factor


def good_turing(counts_of_counts: dict[int, int], cutoff: int = CUTOFF) -> list[float]:
    """Katz's discounts of counts 1 to ``cutoff``; half a count is taken away where counts are too few for them."""
    n = [counts_of_counts.get(r, 0) for r in range(cutoff + 2)]
    common = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, cutoff + 1):
        d = 0.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


@dataclass
class Model:
    """The tables are at ``location``, by order; everything else is bounded by 1 / SHARE."""

    location: str
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int
    classes: Classes
    weights: Weights
    frequent: tuple[np.ndarray, np.ndarray]  # bigram keys, sorted, and their log10 probabilities
    buckets: int = 0


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _step(c: str) -> Column:
    """Counts in steps of an eighth of their power of two."""
    return F.floor(8 * F.log2(F.col(c)))


def _lowest_step(unigrams: DataFrame, most: int) -> int:
    """The lowest step of counts down to which there are at most ``most`` words."""
    steps = unigrams.groupBy(_step("c").alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    lowest, words = 1 << 16, 0
    for row in steps:
        words += row["n"]
        if words > most:
            break
        lowest = row["step"]
    return lowest


def _with_word_counts(bigrams: DataFrame, unigrams: DataFrame, classes: Classes) -> DataFrame:
    """Add ``cw``, the count of the second word: by broadcast where it is frequent, else by a join."""
    spark = bigrams.sparkSession
    known = spark.createDataFrame(pa.table({"w": np.arange(len(classes.hashes)), "cw": classes.counts}))
    is_rare = F.col("w") >= WORD_BIT
    rare = bigrams.where(is_rare).join(unigrams.select(F.col("key").alias("w"), F.col("c").alias("cw")), "w")
    return rare.unionByName(bigrams.where(~is_rare).join(F.broadcast(known), "w"))


def _additions(bigrams: DataFrame, weights: Weights, cutoff: int, denominator: float) -> DataFrame:
    """key, x: by bigram the log10 of P(w | h) less that of a(h) P(w), and by history that is not frequent log10 a(h).

    ``bigrams`` has h, w, c, cw: those with a word that is not frequent.
    """
    spark = bigrams.sparkSession
    ids = np.arange(len(weights.log_seen))
    known = spark.createDataFrame(pa.table({"h": ids, "log_seen": weights.log_seen, "log_back": weights.log_back}))
    is_rare = F.col("h") >= WORD_BIT
    own = Window.partitionBy("h")
    # all bigrams of such a history are here, fewer of them than its count
    c, dc, p, low = (F.sum(x).over(own) for x in (F.col("c"), _discount(weights.discounts) * F.col("c"), (F.col("cw") + 0.5) / denominator, (F.col("c") <= cutoff).cast("int")))
    sums = bigrams.where(is_rare).withColumns({"sum": c + F.when(low == 0, 1).otherwise(0), "dc": dc, "unseen": 1 - p, "place": F.row_number().over(own.orderBy("w"))})
    full = F.col("unseen") < 1e-9
    whole = F.when(full, F.col("dc")).otherwise(F.col("sum"))
    by_own = sums.withColumns({
        "log_seen": -F.log10(whole),
        "log_back": F.when(full, 0.0).otherwise(F.log10((1 - F.col("dc") / whole) / F.col("unseen"))),
    })
    by_known = bigrams.where(~is_rare).join(F.broadcast(known), "h").withColumn("place", F.lit(0))
    columns = ["h", "w", "place", "log_back", (
        F.log10(_discount(weights.discounts) * F.col("c")) + F.col("log_seen") - F.col("log_back") - F.log10((F.col("cw") + 0.5) / denominator)
    ).alias("x")]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, place, back, x = (column.to_numpy() for column in batch.columns)
            first = place == 1
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_pair_keys(h, w), h[first]])), pa.array(np.concatenate([x, back[first]]))], names=["key", "x"])

    return by_own.select(columns).unionByName(by_known.select(columns)).mapInArrow(keyed, "key long, x double")


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on by place of their bytes, the lowest first, without places that are 0 in all: these compress well."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(block: bytes) -> np.ndarray:
    places = np.frombuffer(block, np.uint8, offset=1).reshape(block[0], -1)
    values = np.zeros((places.shape[1], 8), np.uint8)
    values[:, : block[0]] = places.T
    return values.view("<i8").ravel()


def _gaps(values: np.ndarray, start: int = 0) -> bytes:
    """The same of sorted numbers from ``start`` on."""
    return _packed(np.diff(values, prepend=start))


def _ungapped(block: bytes, start: int = 0) -> np.ndarray:
    return np.cumsum(_unpacked(block)) + start


def _mixed(h: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Number of each pair of ids, below 1 << 2 * bits; pairs spread evenly, and no two have one number."""
    mask = np.uint64((1 << 2 * bits) - 1)
    z = (h << bits | w).astype(np.uint64) * np.uint64(MIX) & mask
    return ((z ^ z >> np.uint64(bits)) * np.uint64(MIX) & mask).astype(np.int64)


def _unmixed(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask, back = np.uint64((1 << 2 * bits) - 1), np.uint64(pow(MIX, -1, 1 << 64))
    z = keys.astype(np.uint64) * back & mask
    pair = ((z ^ z >> np.uint64(bits)) * back & mask).astype(np.int64)
    return pair >> bits, pair & (1 << bits) - 1


def _span(first: int, end: int, buckets: int) -> int:
    """Numbers in each of ``buckets`` ranges from ``first`` to ``end``."""
    return (end - first) // buckets + 1


def _ranges(keys: np.ndarray, first: int, end: int, buckets: int) -> Iterator[tuple[int, int, slice]]:
    """Bucket, its first number and its part of sorted ``keys``, where it has any."""
    span = _span(first, end, buckets)
    cuts = np.searchsorted(keys, [first + span * b for b in range(1, buckets)]).tolist()
    for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
        if i < j:
            yield b, first + span * b, slice(i, j)


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


# By bucket: pairs of frequent words by number; others by hash, with both words
PAIRS = "bucket int, keys binary, h binary, w binary, counts binary"
PAIRS_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("h", pa.binary()), ("w", pa.binary()), ("counts", pa.binary()), ("order", pa.string())])


def _pair_blocks(keys: np.ndarray, counts: np.ndarray, bits: int, buckets: int) -> list[tuple]:
    return [(b, _gaps(keys[at], start), None, None, _packed(counts[at]), "2") for b, start, at in _ranges(keys, 0, 1 << 2 * bits, buckets)]


def _rare_blocks(keys: np.ndarray, counts: np.ndarray, h: np.ndarray, w: np.ndarray, buckets: int) -> list[tuple]:
    return [(b, None, _packed(h[at]), _packed(w[at]), _packed(counts[at]), "rare") for b, _, at in _ranges(keys, PAIR_BIT, WORD_BIT, buckets)]


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys, sums of their counts, and what else goes with a key."""
    keys, counts, *others = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first), *[x[order[first]] for x in others]


def _pair_counts(docs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """All bigrams of ``text`` and their counts, in blocks: one of each kind for each bucket."""

    def of_texts(texts: pa.Array) -> pa.RecordBatch:
        classes = shared.value
        hashes, flat, sizes = _split(texts)
        ids = classes.ids(hashes)
        own = np.where(ids == len(classes.hashes), hashes, ids)
        h, w = own[_before(flat, sizes)], own[flat]
        rare = (h | w) >= WORD_BIT
        rows = _pair_blocks(*np.unique(_mixed(h[~rare], w[~rare], classes.bits), return_counts=True), classes.bits, buckets)
        h, w = h[rare], w[rare]
        keys, first, times = np.unique(_pair_keys(h, w), return_index=True, return_counts=True)
        return _records(rows + _rare_blocks(keys, times, h[first], w[first], buckets), PAIRS_SCHEMA)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield of_texts(piece.column("text"))

    def add(bucket: tuple, table: pa.Table) -> pa.Table:
        bits, b = shared.value.bits, bucket[0].as_py()
        start = _span(0, 1 << 2 * bits, buckets) * b
        frequent, rare = [], []
        for row in table.to_pylist():
            counts = _unpacked(row["counts"])
            if row["order"] == "2":
                frequent.append((_ungapped(row["keys"], start), counts))
            else:
                h, w = _unpacked(row["h"]), _unpacked(row["w"])
                rare.append((_pair_keys(h, w), counts, h, w))
        rows = _pair_blocks(*_summed(frequent), bits, buckets) if frequent else []
        rows += _rare_blocks(*_summed(rare), buckets) if rare else []
        return pa.Table.from_batches([_records(rows, PAIRS_SCHEMA)])

    schema = f"{PAIRS}, order string"
    return docs.select("text").mapInArrow(count, schema).groupBy("bucket").applyInArrow(add, schema)


def _each(blocks: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """Rows with the columns that ``rows`` makes of the given ones of each block."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(*row)], names=names)

    return blocks.select(columns).mapInArrow(run, schema)


def _frequent_pairs(blocks: DataFrame, buckets: int, bits: int, schema: str, rows) -> DataFrame:
    """What ``rows`` makes of the keys, as those of ``_bigrams``, and counts of each block."""
    span = _span(0, 1 << 2 * bits, buckets)

    def own(bucket: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
        h, w = _unmixed(_ungapped(keys, span * bucket), bits)
        return rows(h << SHIFT | w, _unpacked(counts))

    return _each(blocks.where("order = '2'"), ["bucket", "keys", "counts"], schema, own)


def _rare_pairs(blocks: DataFrame) -> DataFrame:
    return _each(blocks.where("order = 'rare'"), ["h", "w", "counts"], "h long, w long, c long", lambda *row: tuple(map(_unpacked, row)))


def _counts_of_counts(blocks: DataFrame, most: int) -> DataFrame:
    def rows(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        c = _unpacked(counts)
        return np.arange(1, most + 1), np.bincount(c[c <= most], minlength=most + 1)[1:]

    return _each(blocks, ["counts"], "c long, n long", rows).groupBy("c").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, share: float = SHARE, cutoff: int = CUTOFF, every_word: bool = False) -> Model:
    """Count the n-grams of ``text`` in all rows of ``docs``, write them, and work out the weights.

    With ``every_word`` no words share a class; ``share`` then only says how many are broadcast.
    """
    spark = docs.sparkSession
    location = new_location(spark, "katz")

    def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashes, flat, sizes = _split(texts)
        counts = np.bincount(flat[flat >= 0], minlength=len(hashes))
        counts[-1] = len(sizes)
        return hashes, counts

    _counted(docs, words).write.option("compression", "zstd").parquet(f"{location}/order=1")
    unigrams = spark.read.schema("key long, c long").parquet(f"{location}/order=1")
    total = unigrams.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    least = max(2, ceil(n * share))
    is_common = (F.col("c") >= least) | (F.col("key") == END)
    if every_word:
        is_common |= _step("c") >= _lowest_step(unigrams, int(1 / share / 4))
    # at most 1 / share rows, and the end mark
    common = _columns(unigrams.where(is_common))
    order = np.argsort(common["key"])
    hashes, counts = common["key"][order], common["c"][order]
    if not len(hashes):
        hashes, counts = np.array([END]), np.array([0])
    rest = 0 if every_word else n - int(counts.sum())
    size = len(hashes)
    denominator = n + 0.5 * ((v if every_word else size) + 1)
    log_p = np.log10((np.append(counts, rest) + 0.5) / denominator)
    classes = Classes(hashes, counts, log_p, every_word)
    shared = spark.sparkContext.broadcast(classes)

    def pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_bigrams(*_split(texts), shared.value), return_counts=True)

    if every_word:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n / BUCKET_TOKENS))
        _pair_counts(docs, shared, buckets).write.option("compression", "zstd").partitionBy("order").parquet(f"{location}/pairs")
        blocks = spark.read.schema(f"{PAIRS}, order string").parquet(f"{location}/pairs")
        seen = _counts_of_counts(blocks, cutoff + 1)
    else:
        buckets = 0
        _counted(docs, pairs).write.option("compression", "zstd").parquet(f"{location}/order=2")
        bigrams = spark.read.schema("key long, c long").parquet(f"{location}/order=2")
        seen = bigrams.where(F.col("c") <= cutoff + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    release(spark)
    discounts = good_turing({r["c"]: r["n"] for r in seen.collect()}, cutoff)

    def by_history(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        h, own = np.unique(key >> SHIFT, return_inverse=True)
        p = 10.0 ** shared.value.log_p[key & (1 << SHIFT) - 1]
        return h, *(np.bincount(own, x, len(h)) for x in (c, _discounted(discounts, c), p, c <= cutoff))

    sums_schema, hot_schema = "h long, c double, dc double, p double, low double", "key long, c long"
    if every_word:
        parts = _frequent_pairs(blocks, buckets, classes.bits, sums_schema, by_history)
        hot = _frequent_pairs(blocks, buckets, classes.bits, hot_schema, lambda key, c: (key[c >= least], c[c >= least]))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = by_history(batch.column("key").to_numpy(), batch.column("c").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums], names=["h", "c", "dc", "p", "low"])

        parts = bigrams.mapInArrow(run, sums_schema)
        hot = bigrams.where(F.col("c") >= least)
    if every_word:
        rare = _rare_pairs(blocks)
        rare_location = f"{location}/rare"
        _with_word_counts(rare, unigrams, classes).write.option("compression", "zstd").parquet(rare_location)
        rare = spark.read.schema("h long, w long, c long, cw long").parquet(rare_location).select("h", "w", "c", "cw")
        parts = parts.unionByName(rare.where(F.col("h") < WORD_BIT).select(
            "h", F.col("c").cast("double"), (_discount(discounts) * F.col("c")).alias("dc"), ((F.col("cw") + 0.5) / denominator).alias("p"),
            (F.col("c") <= cutoff).cast("double").alias("low"),
        ))
    sums = _columns(parts.groupBy("h").agg(*[F.sum(x).alias(x) for x in ("c", "dc", "p", "low")]))
    log_seen, log_back = np.zeros(size + 1), np.zeros(size + 1)
    whole = sums["c"] + (sums["low"] == 0)
    unseen = 1 - sums["p"]
    full = unseen < 1e-9  # nothing is unseen after these: scale what is seen to 1
    whole = np.where(full, sums["dc"], whole)
    log_seen[sums["h"]] = -np.log10(whole)
    left = np.where(full, 1.0, 1 - sums["dc"] / whole)
    log_back[sums["h"]] = np.log10(left / np.where(full, 1.0, unseen))
    weights = Weights(log_seen, log_back, discounts)
    if every_word:
        _additions(rare, weights, cutoff, denominator).write.option("compression", "zstd").parquet(f"{location}/additions")
        # nothing reads what these came from any more
        discard(spark, f"{location}/pairs/order=rare")
        discard(spark, rare_location)
        release(spark)
    hot = _columns(hot)  # at most 1 / share rows
    order = np.argsort(hot["key"])
    keys = hot["key"][order]
    frequent = keys, weights.log_bigram(keys, hot["c"][order]) if len(keys) else np.zeros(0)
    return Model(location, n, v, rest, v - int((counts > 0).sum()), classes, weights, frequent, buckets)


def _looked_up(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(key, doc, part, n): distinct n-grams of each document to look up; and one row with what is known of it already.

    ``known`` has tokens, tokens of frequent classes that were seen, other words,
    the sum of log10(c + 1/2) of the frequent ones and of log10 P of the frequent bigrams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (hot, hot_log) = shared.value
        rare_class = len(classes.hashes)
        log_c = np.append(np.log10(classes.counts + 0.5), 0.0)
        seen = np.append(classes.counts > 0, False)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = np.array(piece.column("doc").to_pylist(), np.int64)
                own_part = np.array(piece.column("part").to_pylist(), np.int64)
                hashes, flat, sizes = _split(piece.column("text"))
                text = np.repeat(np.arange(len(sizes)), sizes)
                own = classes.ids(hashes)[flat]
                rare = own == rare_class
                bigrams = _bigrams(hashes, flat, sizes, classes)
                key, count = np.unique(text << 2 * SHIFT | bigrams, return_counts=True)
                where, key = key >> 2 * SHIFT, key & (1 << 2 * SHIFT) - 1
                place = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
                is_hot = hot[place] == key if len(hot) else np.zeros(len(key), bool)
                words = len(hashes)
                word, times = np.unique(text[rare] * words + flat[rare], return_counts=True)
                n = len(sizes)
                hot_sum = np.bincount(where[is_hot], count[is_hot] * hot_log[place[is_hot]], n) if len(hot) else np.zeros(n)
                known = np.stack([
                    sizes, np.bincount(text, seen[own], n), np.bincount(text, rare, n), np.bincount(text, log_c[own], n), hot_sum,
                ], axis=1)
                cold = ~is_hot
                doc, part = (np.concatenate([x[where[cold]], x[word // words], x]) for x in (ids, own_part))
                total = len(doc)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([np.zeros(total - n, np.int32), np.arange(n + 1, dtype=np.int32) * 5]), pa.int32()),
                    pa.array(known.ravel()), mask=pa.array(np.arange(total) < total - n),
                )
                # rows that only carry sums are spread by document; no n-gram has a negative key
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([key[cold], hashes[word % words], -1 - ((ids ^ own_part) & 0x7FFFFFFF)])), pa.array(doc), pa.array(part),
                    pa.array(np.concatenate([count[cold], times, np.zeros(n, np.int64)]).astype(np.int32)), lists,
                ], names=["key", "doc", "part", "n", "known"])

    return docs.mapInArrow(run, "key long, doc long, part long, n int, known array<double>")


# By piece of texts and bucket: n-grams of a kind, in how many texts each is, which and how often; by piece: ids, and what is known of each text.
REQUESTS = "bucket int, chunk long, kind int, keys binary, texts binary, text binary, n binary, ids array<long>, known binary"
REQUESTS_SCHEMA = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary()), ("text", pa.binary()),
    ("n", pa.binary()), ("ids", pa.list_(pa.int64())), ("known", pa.binary()),
])
FREQUENT, RARE, WORD, KNOWN = range(4)
SUMS = "chunk long, ids array<long>, known binary, text binary, n_known binary, base binary, score binary"
SUMS_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("known", pa.binary()), ("text", pa.binary()), ("n_known", pa.binary()),
    ("base", pa.binary()), ("score", pa.binary()),
])


def _kind_ranges(bits: int) -> list[tuple[int, int]]:
    """Keys of each kind of n-gram."""
    return [(0, 1 << 2 * bits), (PAIR_BIT, WORD_BIT), (WORD_BIT, 2 * WORD_BIT)]


def _asked(docs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """N-grams of ``doc_id`` and ``text`` to look up, in blocks, and what is known of each text already.

    ``known`` has by text: tokens, frequent tokens that were seen, other words, the sum of
    log10(c + 1/2) of the frequent ones, and a sum of log10 P of the frequent bigrams, and of log10 a(h) and
    log10 P(w) of the frequent words in bigrams that have another word too.
    """

    def of_piece(piece: pa.RecordBatch, chunk: int, hot: np.ndarray, hot_log: np.ndarray) -> pa.RecordBatch:
        classes, _, weights = shared.value
        bits, other = classes.bits, len(classes.hashes)
        log_c = np.append(np.log10(classes.counts + 0.5), 0.0)
        seen = np.append(classes.counts > 0, False)
        hashes, flat, sizes = _split(piece.column("text"))
        n = len(sizes)
        text = np.repeat(np.arange(n), sizes)
        text_bits = n.bit_length()
        ids = classes.ids(hashes)
        w = ids[flat]
        before = _before(flat, sizes)
        h = ids[before]
        rare = w == other
        mixed = rare | (h == other)

        whole, times = np.unique(_mixed(h[~mixed], w[~mixed], bits) << text_bits | text[~mixed], return_counts=True)
        key, where = whole >> text_bits, whole & (1 << text_bits) - 1
        place = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
        is_hot = hot[place] == key if len(hot) else np.zeros(len(key), bool)
        sums = np.bincount(where[is_hot], times[is_hot] * hot_log[place[is_hot]], n) if len(hot) else np.zeros(n)
        frequent = key[~is_hot], where[~is_hot], times[~is_hot]

        known_part = np.where(h == other, 0.0, weights.log_back[h]) + np.where(rare, 0.0, classes.log_p[w])
        sums = sums + np.bincount(text[mixed], known_part[mixed], n)
        codes = np.where(ids == other, hashes, ids)
        pairs = _by_key(_pair_keys(codes[before[mixed]], codes[flat[mixed]]), text[mixed])
        words = _by_key(hashes[flat[rare]], text[rare])
        rows = [row for kind, grams in enumerate((frequent, pairs, words)) for row in _asked_blocks(chunk, kind, *grams, _kind_ranges(bits)[kind], buckets)]
        known = np.stack([sizes, np.bincount(text, seen[w], n), np.bincount(text, rare, n), np.bincount(text, log_c[w], n), sums])
        rows.append((chunk % buckets, chunk, KNOWN, None, None, None, None, piece.column("doc_id").to_pylist(), known.astype("<f8").tobytes()))
        return _records(rows, REQUESTS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (hot, hot_log), _ = shared.value
        hot = _mixed(hot >> SHIFT, hot & (1 << SHIFT) - 1, classes.bits)
        order = np.argsort(hot)
        hot, hot_log = hot[order], hot_log[order]
        first_chunk = TaskContext.get().partitionId() << 32
        done = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                chunk, done = first_chunk + done, done + 1
                yield of_piece(piece, chunk, hot, hot_log)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, REQUESTS)


def _by_key(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, text) in this order, and how often each is there."""
    order = np.lexsort((text, keys))
    keys, text = keys[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], text[first], np.diff(first, append=len(keys))


def _asked_blocks(chunk: int, kind: int, keys: np.ndarray, text: np.ndarray, n: np.ndarray, limits: tuple[int, int], buckets: int) -> Iterator[tuple]:
    for b, start, at in _ranges(keys, *limits, buckets):
        own = keys[at]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield b, chunk, kind, _gaps(own[first], start), _packed(np.diff(first, append=len(own))), _packed(text[at]), _packed(n[at]), None, None


# By bucket: n-grams of a kind, and their counts or numbers
TABLES = "bucket int, kind int, keys binary, counts binary, x binary"
TABLES_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("x", pa.binary())])


def _in_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` of key and c, or key and x, in blocks of what a task has of a bucket."""

    def blocks(parts: list[tuple[np.ndarray, np.ndarray]], is_count: bool) -> pa.RecordBatch:
        keys, values = map(np.concatenate, zip(*parts))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        cut = np.searchsorted(keys, WORD_BIT)
        return _records([
            (b, kind, _gaps(keys[own][at], start), *((_packed(values[own][at]), None) if is_count else (None, values[own][at].tobytes())))
            for kind, own in ((RARE, slice(0, cut)), (WORD, slice(cut, None)))
            for b, start, at in _ranges(keys[own], *_kind_ranges(0)[kind], buckets)
        ], TABLES_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            is_count = batch.schema.names[1] == "c"
            parts.append(tuple(column.to_numpy() for column in batch.columns))
            held += batch.num_rows
            if held >= HELD_KEYS:
                yield blocks(parts, is_count)
                parts, held = [], 0
        if held:
            yield blocks(parts, is_count)

    return rows.mapInArrow(run, TABLES)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """The value of each wanted key; ``keys`` are sorted."""
    if not len(keys):
        return np.full(len(wanted), missing)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], missing)


def _answers(shared: Broadcast, buckets: int):
    """What the n-grams of one bucket add to the texts that have them."""

    def run(bucket: tuple, asked: pa.Table, tables: pa.Table) -> pa.Table:
        classes, _, weights = shared.value
        bits, b = classes.bits, bucket[0].as_py()
        starts = [first + _span(first, end, buckets) * b for first, end in _kind_ranges(bits)]
        parts = [(row["kind"], row["counts"] is None, _ungapped(row["keys"], starts[row["kind"]]),
                  np.frombuffer(row["x"]) if row["counts"] is None else _unpacked(row["counts"])) for row in tables.to_pylist()]

        def sorted_table(kind: int, is_x: bool) -> tuple[np.ndarray, np.ndarray]:
            own = [part[2:] for part in parts if part[:2] == (kind, is_x)]
            keys, values = map(np.concatenate, zip(*own)) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(keys)
            return keys[order], values[order]

        pair, pair_counts = sorted_table(FREQUENT, False)
        log_pair = np.log10(_discounted(weights.discounts, pair_counts)) + weights.log_seen[_unmixed(pair, bits)[0]]
        counts, additions = sorted_table(WORD, False), {kind: sorted_table(kind, True) for kind in (RARE, WORD)}
        rows = []
        for row in asked.to_pylist():
            if row["kind"] == KNOWN:
                rows.append((row["chunk"], row["ids"], row["known"], None, None, None, None))
                continue
            kind = row["kind"]
            keys = _ungapped(row["keys"], starts[kind])
            text, n, texts = (_unpacked(row[x]) for x in ("text", "n", "texts"))
            there = np.flatnonzero(np.bincount(text))

            def summed(values: np.ndarray) -> np.ndarray:
                return np.bincount(text, np.repeat(values, texts) * n)[there]

            known = base = None
            if kind == FREQUENT:
                h, w = _unmixed(keys, bits)
                score = _found(pair, log_pair, keys, np.nan)
                score = np.where(np.isnan(score), weights.log_back[h] + classes.log_p[w], score)
            else:
                score = _found(*additions[kind], keys, 0.0)
            if kind == WORD:
                c = _found(*counts, keys, 0)
                log_c = np.log10(c + 0.5)
                known, base, score = _packed(summed(c > 0).astype(np.int64)), summed(log_c).tobytes(), score + log_c
            rows.append((row["chunk"], None, None, _gaps(there), known, base, summed(score).tobytes()))
        return pa.Table.from_batches([_records(rows, SUMS_SCHEMA)])

    return run


def _scores_of_every_word(docs: DataFrame, model: Model) -> DataFrame:
    """``scores`` by a model of every word: blocks of n-grams meet the tables by bucket, and their sums each other by piece of texts."""
    spark = docs.sparkSession
    buckets = model.buckets
    shared = spark.sparkContext.broadcast((model.classes, model.frequent, model.weights))
    words = spark.read.schema("key long, c long").parquet(f"{model.location}/order=1")
    additions = spark.read.schema("key long, x double").parquet(f"{model.location}/additions")
    pairs = spark.read.schema(f"{PAIRS}, order string").parquet(f"{model.location}/pairs").where("order = '2'")
    pairs = pairs.select("bucket", F.lit(FREQUENT).alias("kind"), "keys", "counts", F.lit(None).cast("binary").alias("x"))
    tables = pairs.unionByName(_in_blocks(words, buckets)).unionByName(_in_blocks(additions, buckets))
    sums = _asked(docs, shared, buckets).groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_answers(shared, buckets), SUMS)
    per_token = log10(model.tokens + 0.5 * (model.distinct + 1))
    train_tokens = model.tokens

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, known = next((row["ids"], row["known"]) for row in rows if row["ids"] is not None)
        tokens, n_known, rare, base, score = np.frombuffer(known, "<f8").reshape(5, -1).copy()
        for row in rows:
            if row["ids"] is None:
                text = _ungapped(row["text"])
                score[text] += np.frombuffer(row["score"])
                if row["base"] is not None:
                    n_known[text] += _unpacked(row["n_known"])
                    base[text] += np.frombuffer(row["base"])
        long = pa.int64()
        return pa.table({
            "doc_id": pa.array(ids, long), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), train_tokens), long), "base_score": base - tokens * per_token, "score": score - rare * per_token,
        })

    return sums.groupBy("chunk").applyInArrow(total, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    spark = docs.sparkSession
    if model.classes.every_word:
        return _scores_of_every_word(docs, model)
    source = document_keys(docs)
    shared = spark.sparkContext.broadcast((model.classes, model.frequent))
    tables = spark.read.schema("key long, c long").parquet(f"{model.location}/order=1", f"{model.location}/order=2")
    by_class = np.arange(len(model.classes.hashes) + 1)
    histories = spark.createDataFrame(pa.table({"h": by_class, "log_seen": model.weights.log_seen, "log_back": model.weights.log_back}))
    words = spark.createDataFrame(pa.table({"w": by_class, "log_p": model.classes.log_p}))
    joined = (
        _looked_up(source, shared).join(tables.hint("merge"), "key", "left")
        .join(F.broadcast(histories), F.shiftright("key", SHIFT) == F.col("h"), "left")
        .join(F.broadcast(words), F.col("key").bitwiseAND((1 << SHIFT) - 1) == F.col("w"), "left")
    )
    is_word, is_bigram = F.col("key") >= WORD_BIT, F.col("key").between(0, WORD_BIT - 1)
    discount = _discount(model.weights.discounts)
    n = F.col("n")
    sums = joined.groupBy("doc", "part").agg(
        F.sum((F.size("known") > 0).cast("int")).alias("rows"),
        *[F.sum(F.col("known")[i]).alias(f"k{i}") for i in range(5)],
        F.sum(F.when(is_word & F.col("c").isNotNull(), n).otherwise(0)).alias("rare_known"),
        F.sum(F.when(is_word, n * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)).alias("rare_log"),
        F.sum(
            F.when(is_bigram & F.col("c").isNotNull(), n * (F.log10(discount * F.col("c")) + F.col("log_seen")))
            .when(is_bigram, n * (F.col("log_back") + F.col("log_p"))).otherwise(0.0)
        ).alias("bigram_log"),
    )
    per_token = log10(model.tokens + 0.5 * (model.distinct + 1))
    per_rare = log10(model.rare_tokens + 0.5 * (model.rare_distinct + 1))
    base = F.col("k3") + F.col("rare_log") - F.col("k0") * per_token
    score = F.col("k4") + F.col("bigram_log") + F.col("rare_log") - F.col("k2") * per_rare
    # equal rows have been summed together
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(
        id_of_keys().alias("doc_id"),
        F.round(F.col("k0") / F.col("rows")).cast("long").alias("n_tokens"),
        F.round((F.col("k1") + F.col("rare_known")) / F.col("rows")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (base / F.col("rows")).alias("base_score"), (score / F.col("rows")).alias("score"),
    )


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def report(docs: DataFrame, every_word: bool = False) -> DataFrame:
    """Fit on the rows that are not held out, score all."""
    train = docs.where(~held_out())
    model = fit(train, every_word=True) if every_word else fit(train)
    return scores(docs, model).withColumn("held_out", held_out())
