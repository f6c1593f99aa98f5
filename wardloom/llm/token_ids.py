"""Token ids in Simple-8b words, in order of doc_id.

``write_token_ids`` encodes texts and writes a table of blocks; ``read_token_ids``
and ``read_digests`` read it back. The table is Parquet, so that Spark's own
commit makes a retried task harmless on any store; a row is a block:

    shard, block        place in the order; a shard is one task's range of doc_id
    shard_start         ids in the shard before this block
    n_ids               ids in the block
    words, lanes        Simple-8b words (little-endian) and first word of each lane (int32)
    escapes             values that need more than 60 bits
    doc_ids, doc_tokens the documents of the block and their numbers of ids

Documents are never cut between blocks, and a block is closed as soon as it
holds ``BLOCK_IDS`` ids, so a block is at most that plus one document.

Defined cases: a null text is empty, an empty text gives just the end id; a
null doc_id comes first; rows that repeat a doc_id (or have none) are all kept,
ordered by a hash of the text; an added token of the vocabulary in a text, such
as an end marker, is that token, as the tokenizer has it; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import simple8b
from wardloom.llm.common import pieces
from wardloom.sources.sinks import new_location

END_ID = 2
BLOCK_IDS = 1 << 19
# Pieces whose ids a worker remembers; beyond, it forgets all and starts again.
REMEMBERED = 1_000_000
RUN = 50

# A byte-level vocabulary of this kind splits a text before each space or line
# break that follows another character than white space. Only where such a
# character follows white space and more white space follows it, or the end,
# does the split depend on more than the piece that it begins. It also splits
# between letters, digits and other signs; the apostrophe belongs to either side.
_UNSURE = re.compile(r"\s[ \n](?:\s|$)|^[ \n](?:\s|$)")
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, 0x0A]] = True
_KINDS = np.zeros(256, np.uint8)
for _byte in range(0x21, 0x7F):
    _KINDS[_byte] = 0 if _byte == 0x27 else 1 if chr(_byte).isalpha() else 2 if chr(_byte).isdigit() else 3
# Bytes that white space of other kinds has or begins with.
_STRANGE = np.zeros(256, bool)
_STRANGE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes with a byte-level tokenizer, each new piece of text once.

    Merges never cross the tokenizer's own splits, so the ids of a text are
    those of the pieces that its spaces and line breaks begin, cut again where
    letters, digits and signs meet; most of these have been seen before. A batch is cut into pieces where its bytes lie, the
    distinct pieces are looked up, and the ids of all pieces are gathered at
    once. Texts with runs of white space, or with an added token of the
    vocabulary in them, are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # every piece comes here once
        # a token of a byte-level vocabulary is spelled with one character for each byte
        spelled = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(spelled.values()) + 1, np.int64)
        self.sizes[list(spelled.values())] = list(map(len, spelled))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of pieces; many in one call, told apart by their bytes."""
        closed, alone = [], []
        for piece in new:
            end = piece[-1]
            plain = 0x20 < end < 0x7F or not piece.decode()[-1].isspace()
            (closed if plain and len(piece) > 1 and piece[0] in b" \n" else alone).append(piece)
        # short runs suit the tokenizer best
        runs = [b"".join(closed[i : i + RUN]).decode() for i in range(0, len(closed), RUN)]
        coded = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.array([i for c in coded for i in c.ids], "<u4")
        reached, wanted = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, closed), np.int64, len(closed)))
        ends = np.searchsorted(reached, wanted)
        if len(ids) and (reached[np.minimum(ends, len(ids) - 1)] == wanted).all():
            ends, data = (4 * (ends + 1)).tolist(), ids.tobytes()
            self.known.update(zip(closed, [data[a:b] for a, b in zip([0, *ends], ends)]))
        else:
            alone += closed
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)
        self.known.update((p, np.array(c.ids, "<u4").tobytes()) for p, c in zip(alone, coded))

    def _odd(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text must be encoded as a whole."""
        odd = np.zeros(len(texts), bool)
        separators = _SEPARATORS[data]
        doubled = separators[1:] & separators[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        doubled[inner - 1] = False  # not across texts
        doubled = np.flatnonzero(doubled)
        places = np.concatenate([doubled, np.flatnonzero(_STRANGE[data])])
        asked = np.zeros(len(texts), bool)
        asked[np.searchsorted(offsets, places, side="right") - 1] = True
        filled = np.flatnonzero(np.diff(offsets) > 0)
        asked[filled[separators[offsets[filled]] | separators[offsets[filled + 1] - 1]]] = True
        for i in np.flatnonzero(asked).tolist():
            odd[i] = bool(_UNSURE.search(texts[i].as_py()))
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array of strings without nulls) end to end, and how many each has."""
        texts = pa.concat_arrays([texts])  # a copy of its own, from offset 0
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = self._odd(texts, data, offsets) if len(data) else np.zeros(len(texts), bool)
        marks = _SEPARATORS[data]
        kinds = _KINDS[data]
        marks[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
        marks[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(marks)
        edges = np.append(begins, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), texts.buffers()[2]]).dictionary_encode()
        _, places, held = coded.dictionary.buffers()
        cuts, raw = np.frombuffer(places, np.int32)[: len(coded.dictionary) + 1].tolist(), (held or pa.py_buffer(b"")).to_pybytes()
        distinct = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = distinct
        self._learn(new)
        found = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(found), "<u4")
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[index]
        of_text = np.searchsorted(begins, offsets)  # first piece of each text
        if odd.any():
            lengths[np.repeat(odd, np.diff(of_text))] = 0
        reached = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(reached[of_text])
        ids = pool[np.repeat(firsts[index] - reached[:-1], lengths) + np.arange(reached[-1])]
        alone = {i: np.frombuffer(self._whole(texts[i].as_py()), "<u4") for i in np.flatnonzero(odd).tolist()}
        if alone:  # put the ids of texts encoded as a whole between the others'
            before = np.cumsum(counts) - counts
            parts, at = [], 0
            for i, own in alone.items():
                parts += [ids[at : before[i]], own]
                at, counts[i] = before[i], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        _encoders[path] = Encoder(path)
    return _encoders[path]


BLOCK_SCHEMA = (
    "shard int, block int, shard_start long, n_ids long, words binary, lanes binary, escapes binary, "
    "doc_ids array<long>, doc_tokens array<long>"
)
_BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()),
    ("words", pa.binary()), ("lanes", pa.binary()), ("escapes", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
])


def write_token_ids(docs: DataFrame, tokenizer: str, location: str, end_id: int = END_ID) -> None:
    """Encode ``text`` of every row of ``docs`` and write blocks below ``location``.

    One range shuffle by doc_id; each task then encodes and writes its range.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        # rows of one id, or of none, may be in several ranges
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own = encoder(tokenizer)
        docs, sizes, parts, held, before, number = [], [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            packed = simple8b.encode(np.concatenate(parts))
            row = [shard, number, before, packed.count, packed.words.astype("<u8").tobytes(), packed.lanes.astype("<i4").tobytes(),
                   packed.escapes.astype("<u8").tobytes(), np.concatenate(docs).tolist(), np.concatenate(sizes)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK_ARROW)], schema=_BLOCK_ARROW)

        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, counts = own.encode(piece.column("text"))
                counts = counts + 1
                ends = np.cumsum(counts)
                # the end id goes behind each document's own
                with_ends = np.full(int(ends[-1]), end_id, np.uint32)
                inside = np.ones(len(with_ends), bool)
                inside[ends - 1] = False
                with_ends[inside] = ids
                names = np.array(piece.column("doc_id").to_pylist(), object)
                # a block closes with the document that fills it
                at = 0
                while at < len(names):
                    base = int(ends[at - 1]) if at else 0
                    upto = min(int(np.searchsorted(ends, base + BLOCK_IDS - held)) + 1, len(names))
                    docs.append(names[at:upto])
                    sizes.append(counts[at:upto])
                    parts.append(with_ends[base : ends[upto - 1]])
                    held += int(ends[upto - 1]) - base
                    at = upto
                    if held >= BLOCK_IDS:
                        yield block()
                        before, number = before + held, number + 1
                        docs, sizes, parts, held = [], [], [], 0
        if docs:
            yield block()

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(location)


def _blocks(spark: SparkSession, location: str) -> DataFrame:
    """The blocks with ``start``, the ids before each in the whole table.

    A shard is one task's output, so there are as few totals as tasks.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(location)
    totals = (
        blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # shards are ranges in order
    )
    before = dict(zip((r["shard"] for r in totals), np.cumsum([0, *(r["n"] for r in totals)]).tolist()))
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard int, _before long")
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("_before") + F.col("shard_start"))


def _unpack(row: dict) -> np.ndarray:
    return simple8b.decode(simple8b.Block(
        row["n_ids"], np.frombuffer(row["words"], "<u8"), np.frombuffer(row["lanes"], "<i4"), np.frombuffer(row["escapes"], "<u8")
    ))


def _by_document(spark: SparkSession, location: str, of, field: str, kind: str, arrow: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", field]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, sizes = _unpack(row), np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                values = [of(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"]), pa.array(sizes), pa.array(values, arrow)
                ], names=names)

    needed = _blocks(spark, location).select("start", "n_ids", "words", "lanes", "escapes", "doc_ids", "doc_tokens")
    return needed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {field} {kind}")


def read_token_ids(spark: SparkSession, location: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in the blocks."""
    return _by_document(spark, location, lambda ids: ids.astype(np.int64), "ids", "array<long>", pa.list_(pa.int64()))


def read_digests(spark: SparkSession, location: str) -> DataFrame:
    """As :func:`read_token_ids`, with a CRC-32 of the ids as 32-bit integers instead of the ids."""
    return _by_document(
        spark, location, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", "long", pa.int64()
    )


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to the shared folder, read the files back, one row for each document."""
    location = new_location(docs.sparkSession, "token-ids")
    write_token_ids(docs, tokenizer, location)
    return read_digests(docs.sparkSession, location)
