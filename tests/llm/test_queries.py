"""The queries themselves on the smallest tables, against SQL or their contract by brute force."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from meterlake.llm.queries import ORACLES, QUERIES, URL_RULES

from ..test_queries import rows
from .test_audits import judged
from .test_dedup import brute_passages, components, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def own(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op6(spark, own):
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, SF).collect()}
    ids = sorted(own)
    assert sorted(got) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(own[i]) // 2
        edited = own[i][: len(own[i]) - half] + own[after][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_op7(spark, own):
    prints = {i: simhash(t) for i, t in own.items()}
    alike = [(a, b) for a in own for b in own if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    first = components(own, alike)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", first[i]) for i in own}


def test_op9(spark, own):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring_dedup"](spark, SF).collect()}
    assert got == brute_passages(own)


def test_op11(spark, duck):
    pages = duck.sql("SELECT page_id, url FROM pages ORDER BY 1").fetchall()
    want = [(i, *w) for (i, _), w in zip(pages, judged([u for _, u in pages], URL_RULES), strict=True)]
    assert sorted(map(tuple, QUERIES["op11_url_filter"](spark, SF).collect())) == want
