import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardloom.llm import simple8b, token_ids
from wardloom.llm.common import table
from wardloom.llm.registry import default_tokenizer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    assert simple8b.decode(simple8b.encode(np.array(values, np.uint64))).tolist() == values


def test_simple8b_layout():
    packed = simple8b.encode(np.array([1] * 60 + [2**60 - 1] + [2**63], np.uint64))
    assert (packed.words >> np.uint64(60)).tolist() == [1, 14, 0]
    assert packed.escapes.tolist() == [2**63]
    assert len(simple8b.encode(np.arange(1000, dtype=np.uint64)).lanes) == 8


def plain():
    return Tokenizer.from_file(default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abZ'st09 .,!(\"\n\t\r\x0b\xa0 é漢😀\x1c<|>", "  ", "\n\n", "<|endoftext|>"]), max_size=40).map("".join), max_size=6))
def test_ids_are_the_tokenizers(texts):
    own = plain()
    ids, counts = token_ids.encoder(default_tokenizer()).encode(pa.array(["cut off", *texts], pa.string())[1:])
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_token_is_itself():
    ids, _ = token_ids.encoder(default_tokenizer()).encode(pa.array(["a <|endoftext|> b"]))
    assert ids.tolist() == [64, 220, 50256, 275]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(token_ids, "REMEMBERED", 5)
    own, texts = plain(), [f"w{i} x{i} y" for i in range(40)]
    coder = token_ids.Encoder(default_tokenizer())
    for _ in range(2):
        ids, counts = coder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in own.encode(t).ids] and len(counts) == 40


def expected(docs):
    own, start, out = plain(), 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [token_ids.BLOCK_IDS, 50])
def test_cases(spark, rows, monkeypatch, block):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", block)
    docs = [(5, "five words are in here"), (1, None), (3, ""), (2, "a\n\nb  c"), (None, "no id"), (4, "same"), (4, "same"), (8, "end <|endoftext|> mark"), (9, "long " * 40_000)]
    got = token_ids.tokenized(rows(docs, "doc_id int, text string"), default_tokenizer())
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(docs)


def test_table_and_ids(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    token_ids.write_token_ids(docs, default_tokenizer(), str(tmp_path / "ids"))
    assert sorted((tuple(r) for r in token_ids.read_digests(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1]) == want
    back = token_ids.read_token_ids(spark, str(tmp_path / "ids")).collect()
    assert {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back} == {d: c for d, _, _, c in want}


def test_empty(spark, rows):
    assert token_ids.tokenized(rows([], "doc_id long, text string"), default_tokenizer()).count() == 0


def test_many_rows_without_id(spark, rows):
    """They are dealt over ranges like any others, and every start counts all rows before."""
    docs = [(None, f"none {i} words here") for i in range(3000)] + [(7, f"seven {i}") for i in range(2000)] + [(i, "x") for i in range(8, 20)]
    frame = rows(docs, "doc_id long, text string").repartition(6)
    got = sorted((tuple(r) for r in token_ids.tokenized(frame, default_tokenizer()).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 3000 + [7] * 2000 + list(range(8, 20))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    own = plain()
    crc = lambda t: zlib.crc32(np.array(own.encode(t).ids + [2], "<u4").tobytes())
    assert sorted(r[3] for r in got) == sorted(crc(t) for _, t in docs)
