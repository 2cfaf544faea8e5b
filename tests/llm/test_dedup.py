"""Line, near-duplicate and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import bloom
from meterlake.llm.components import connected_components
from meterlake.llm.line_dedup import drop_repeated_lines
from meterlake.llm.scratch import Scratch
from meterlake.llm.simhash import FOURS, OF_TWOS, fingerprint_links, keep_first_of_class, least_meetings, near_duplicate_classes
from meterlake.llm.substrings import COVER, PERIOD, WINDOW, remove_repeated_passages

from .conftest import SCHEMA, texts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_lines(documents, docs):
    own = texts(docs)
    holders = defaultdict(set)
    for i, t in own.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    want = {}
    for i, t in own.items():
        kept = [x for x in t.split("\n") if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        want[i] = ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    got = drop_repeated_lines(documents, log2_bits=16)
    assert set(documents.columns) <= set(got.columns)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()} == want
    assert any(w[2] for w in want.values())


def test_lines_are_exact_when_the_filter_is_full(documents):
    rows = lambda bits: sorted((r.doc_id, r.text) for r in drop_repeated_lines(documents, log2_bits=bits).collect())
    assert rows(3) == rows(20)


def test_lines_of_null_ids_and_repeated_rows(spark):
    line = "this line is long enough to count"
    rows = [(None, line), (None, line), (5, line), (5, line), (2, line), (7, "other")]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), log2_bits=12)
    assert sorted(((r.doc_id or 0), r.n_dropped) for r in got.collect()) == [(0, 1), (0, 1), (2, 1), (5, 0), (5, 0), (7, 0)]


def test_bloom_merges_as_one_pass():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 500), rng.integers(0, 1 << 63, 500)
    b[:50] = a[:50]
    one, two = bloom.SeenTwice(16), bloom.SeenTwice(16)
    one.add(a)
    two.add(b)
    _, twice = bloom.merge((one.once, one.twice), (two.once, two.twice))
    assert bloom.has_bits(twice, bloom.positions(a[:50], 16)).all()
    assert bloom.has_bits(twice, bloom.positions(a[50:], 16)).mean() < 0.2


def simhash(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(documents, docs):
    own = {i: simhash(t) for i, t in texts(docs).items()}
    links = [(a, b) for a, b in combinations(own, 2) if bin(own[a] ^ own[b]).count("1") <= 2]
    want = components(own, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicate_classes(documents).collect()}
    assert got == {i: (f"{own[i]:016x}", want[i]) for i in own}
    kept = keep_first_of_class(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in own if want[i] == i}


def test_meetings_tell_shared_bytes():
    for n in range(9):
        for shared in combinations(range(8), n):
            met = [k for k, q in enumerate(FOURS) if set(q) <= set(shared)]
            assert len(met) == {8: 14, 7: 7, 6: 3}.get(n, len(met)) and (n > 5 or len(met) <= 1) and (n < 6 or min(met) < OF_TWOS)
    assert [least_meetings(k) for k in range(3)] == [14, 7, 3]


def test_simhash_of_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, text), (7, text), (7, text), (9, text), (None, "alone and without an id")]
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 7), (0, 7), (7, 7), (7, 7), (9, 7)]


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_crowded_posting_lists_give_the_same_components(spark, crowd):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 6)
    prints = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(40):
            x = s
            for b in rng.integers(0, 63, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            prints.add(x)
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if bin(a ^ b).count("1") <= 2]
    table = spark.createDataFrame([(p,) for p in prints], "_fp long")
    found = [(r.a, r.b) for r in fingerprint_links(table, 2, crowd).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in found)
    assert components(prints, found) == components(prints, links)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_cover_meets_at_every_difference():
    assert all(any((i + k) % PERIOD in COVER and k % PERIOD in COVER for k in range(PERIOD)) for i in range(PERIOD))


def brute_passages(own):
    seen, want = set(), {}
    for i in sorted(own):
        words = own[i].encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - WINDOW + 1):
            window = tuple(words[p : p + WINDOW])
            if window in seen:
                gone[p : p + WINDOW] = [True] * WINDOW
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize(("chunk_words", "bucket_bytes"), [(200, 1 << 20), (1_000_000, 1 << 20), (1000, 2000)])
def test_substrings(documents, docs, chunk_words, bucket_bytes, monkeypatch):
    monkeypatch.setattr("meterlake.llm.substrings.CHUNK_WORDS", chunk_words)
    monkeypatch.setattr("meterlake.llm.substrings.BUCKET_BYTES", bucket_bytes)
    want = brute_passages(texts(docs))
    got = remove_repeated_passages(documents, rejoin=True).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("sha"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 500


def test_substrings_by_shuffle_alone(documents, docs, monkeypatch):
    monkeypatch.setattr("meterlake.llm.substrings.BROADCAST_ROWS", 0)
    got = remove_repeated_passages(documents, rejoin=True)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {i: w[1] for i, w in brute_passages(texts(docs)).items()}


def test_untouched_texts_stay_as_they_are(documents, docs):
    own = dict(docs)
    got = remove_repeated_passages(documents)
    assert all(r.text == own[r.doc_id] for r in got.collect() if not r.n_removed)


def test_substrings_of_repeated_rows(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(4, passage), (4, passage), (None, passage), (9, passage)]
    got = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (4, 30), (4, 30), (9, 30)]


@pytest.mark.parametrize("chunk_words", [20, 1_000_000])
@pytest.mark.parametrize("doc_id", [4, None])
def test_equal_rows_alone_keep_their_first_passage(spark, doc_id, chunk_words, monkeypatch):
    monkeypatch.setattr("meterlake.llm.substrings.CHUNK_WORDS", chunk_words)
    passage = " ".join(f"w{k}" for k in range(30))
    twice = f"{passage} | {passage}"
    rows = spark.createDataFrame([(doc_id, twice), (doc_id, twice)], "doc_id long, text string")
    got = remove_repeated_passages(rows.repartition(2)).collect()
    assert [(r.text, r.n_removed) for r in got] == [(f"{passage} |", 30)] * 2


@pytest.mark.parametrize("operator", [drop_repeated_lines, near_duplicate_classes, keep_first_of_class, remove_repeated_passages])
def test_empty_tables(no_documents, operator):
    assert operator(no_documents).collect() == []


def test_schema_has_clashing_names():
    assert "_id" in SCHEMA
