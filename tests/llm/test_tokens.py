"""Packing and SentencePiece against the tokenizers' own libraries."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm import sentencepieces
from meterlake.llm.packing import ChunkIds, first_fit_decreasing, pack, stretches

from .conftest import texts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = st.lists(st.sampled_from([*"abEé ,.!'sß\n\t 0Σσİ|日本\x1c\xa0ﬁ▁🙂$_", "<|endoftext|>", "<|EndOfText|>", "<0x0A>", "<s>"]), max_size=60).map("".join)


def test_packing(documents, docs):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    own = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in texts(docs).items()}
    pieces = pack(documents, WORD_BPE, docs_per_group=20).collect()
    covered, sequences = Counter(), defaultdict(list)
    for p in pieces:
        ids = own[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(own[p.doc_id]) and len(ids) == p.length
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        covered.update((p.doc_id, p.start + k) for k in range(p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == Counter((i, k) for i, ids in own.items() for k in range(len(ids)))
    for spans in sequences.values():
        ends = [0, *(a + b for a, b in sorted(spans))]
        assert [a for a, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048


def test_packing_of_null_ids_repeats_and_nothing(spark, no_documents):
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (4, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE).collect()
    assert Counter((p.doc_id, p.length) for p in got) == {(None, 3): 1, (3, 3): 2, (4, 1): 1}
    assert pack(no_documents, WORD_BPE).collect() == []


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_of_long_texts_and_other_tokenizers(spark, file, monkeypatch):
    monkeypatch.setattr("meterlake.llm.packing.STRETCH", 1000)
    r = random.Random(5)
    own = {1: " ".join(r.choice(["One", "two's", "3,", "vier\n", "日本"]) for _ in range(4000)), 2: "abc" * 3000, 3: "x\n\ny  z"}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    got = pack(spark.createDataFrame(list(own.items()), "doc_id long, text string"), public_tokenizers.path(file)).collect()
    for i, text in own.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        pieces = sorted((p.start, p.length, p.ids_crc32) for p in got if p.doc_id == i)
        assert [(a, n) for a, n, _ in pieces] == [(k, min(2048, len(ids) - k)) for k in range(0, len(ids), 2048)]
        assert all(c == zlib.crc32(struct.pack(f"<{n}I", *ids[a : a + n])) for a, n, c in pieces)


def test_padding_is_little_and_rows_without_an_id_are_spread(spark):
    r = random.Random(6)
    rows = [(k if k % 3 else None, " ".join(["word"] * min(2000, int(r.expovariate(1 / 300))))) for k in range(3000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD_BPE, docs_per_group=500).collect()
    used, sequences = sum(p.length for p in got), len({p.sequence_id for p in got})
    assert used > 0.97 * 2048 * sequences
    assert len({p.sequence_id >> 32 for p in got if p.doc_id is None}) > 2


def test_first_fit_is_that_of_a_plain_search():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 400))[::-1]
    bins, offsets = first_fit_decreasing(lengths, 100)
    room = [100] * len(lengths)
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        want = next(k for k, free in enumerate(room) if free >= n)
        assert (b, o) == (want, 100 - room[want])
        room[want] -= n


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_chunks_tokenize_alone(parts):
    known = ChunkIds(Path(WORD_BPE).read_text(encoding="utf-8"), limit=9000) if not hasattr(test_chunks_tokenize_alone, "known") else test_chunks_tokenize_alone.known
    test_chunks_tokenize_alone.known = known
    for text in parts:
        chunks = [c for own in stretches(known.folded(text)) for c in own]
        known.learn(set(chunks))
        got = b"".join(known[c] for c in chunks)
        assert got == np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(Path(PIECES).read_bytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_pieces_are_the_librarys(parts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    if not hasattr(test_pieces_are_the_librarys, "known"):
        test_pieces_are_the_librarys.known = sentencepieces.ChunkPieces(sentencepieces.Pieces(Path(PIECES).read_bytes()), limit=20_000)
    known = test_pieces_are_the_librarys.known
    for text, ids in zip(parts, sentencepieces.encoded(known, parts), strict=True):
        assert ids.tolist() == sp.encode(text)
        assert known.pieces.decode(ids.tolist()) == text.replace("▁", " ")


def test_texts_that_are_long_or_have_no_blanks(pieces):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(4)
    known = sentencepieces.ChunkPieces(pieces, limit=200_000)
    letters = "".join(r.choice("etaoinshrdlu") for _ in range(30_000))
    every = "".join(r.choice("abcdefXYZ0123+/日本語の。é") for _ in range(100_000))
    words = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(300_000))
    assert len(words) > 1.5e6
    texts = [letters, every, "a" * 20_000, " " * 5_000, words, "x"]
    for text, ids in zip(texts, sentencepieces.encoded(known, texts), strict=True):
        assert ids.tolist() == sp.encode(text)
    assert known.used < 60_000_000


def test_ids_that_are_none(pieces):
    assert pieces.decode([None, -1, 10**9, 0]) == "\ufffd" * 3 and pieces.decode([]) == ""


def test_suffix_array():
    r = random.Random(6)
    text = "".join(r.choice("ab") for _ in range(200))
    order = sentencepieces.suffix_array(np.frombuffer(text.encode("utf-32-le"), np.uint32), 16)
    assert [text[i : i + 16] for i in order] == sorted(text[i : i + 16] for i in range(200))


def test_codec_on_columns(spark, documents, docs, no_documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    told = sentencepieces.with_pieces(documents.withColumn("_out", F.lit("mine")), PIECES).withColumn("again", sentencepieces.decoder(spark, PIECES)("ids"))
    own = dict(docs)
    rows = told.collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = own[r.doc_id]
        assert r.ids == (None if text is None else sp.encode(text)) and r.decoded == r.again == r.text == text and r._out == "mine"
        assert r.ids_crc32 == (None if text is None else zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)))
    assert sentencepieces.with_pieces(no_documents, PIECES).collect() == []
