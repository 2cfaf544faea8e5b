"""Learned operators, fingerprints and vectors."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import boosting, dom, extraction, quality, sample_pages, toxicity
from meterlake.llm.extraction import extract_main_text, fit_elements
from meterlake.llm.minhash import fingerprints
from meterlake.llm.neighbours import near_vectors
from meterlake.llm.quality import STATISTICS, RuleEnsemble, fit_rules, score_quality, statistics
from meterlake.llm.toxicity import ChainField, score_toxicity

from .conftest import texts

LABELS = "doc_id long, quality int, toxic int"


def labelled_corpus(spark, count=400):
    """Junk is shouted and has symbols; toxic texts hold one of a few words or words of a few beginnings."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(count):
        own = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic, junk = int(r.random() < 0.3), int(r.random() < 0.3)
        if toxic:
            own.insert(r.randrange(len(own)), r.choice(["nastyword", "zzinsult", f"qqx{r.choice(words)}", f"qqx{r.choice(words)}"]))
        text = " ".join(own)
        docs.append((i, text.upper().replace(" ", "*** ") if junk else text.capitalize() + "."))
        if i % 4:
            labels.append((i, 1 - junk, toxic))
    docs += [(None, "Null."), (5000, None), (5001, "")]
    labels += [(None, 1, 0), (7, None, None), (999_999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels if q is not None}


@pytest.mark.parametrize(("score", "modulus", "left_out", "label"), [(score_quality, 3, 1, 0), (score_toxicity, 4, 2, 1)])
def test_classifiers_on_held_out_rows(spark, score, modulus, left_out, label):
    docs, labels, known = labelled_corpus(spark)
    rows = score(docs.withColumn("_out", F.lit(1)).withColumn("_stats", F.lit(2)), labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % modulus == left_out)
        assert 0 <= r.score <= 1 and r._out == 1 and r._stats == 2
    held = [(r.predicted, known[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_classifiers_without_labels_or_rows(spark, score):
    docs, labels, _ = labelled_corpus(spark, 5)
    assert len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1
    assert score(docs.limit(0), labels).collect() == []


def test_spans_are_offsets_into_the_text(spark):
    docs, labels, _ = labelled_corpus(spark)
    found = [(r.text, s) for r in score_toxicity(docs, labels).collect() for s in r.spans]
    assert len(found) > 60
    assert np.mean([t[s.start : s.end].lower().startswith(("nasty", "zzins", "qqx")) for t, s in found]) > 0.95


def test_marginals_are_those_of_all_labellings(monkeypatch):
    monkeypatch.setattr(toxicity, "ROW", 3)
    rng = np.random.default_rng(3)
    chain = ChainField(start=0.4, step=rng.normal(size=(2, 2)))
    lengths = [1, 4, 7, 2]
    unary = rng.normal(size=sum(lengths))
    first = np.concatenate([np.arange(n) == 0 for n in lengths])
    want, at = [], 0
    for n in lengths:
        u, mass = unary[at : at + n], np.zeros(n)
        total = 0.0
        for y in itertools.product((0, 1), repeat=n):
            s = math.exp(chain.start * y[0] + sum(u[k] * y[k] for k in range(n)) + sum(chain.step[a, b] for a, b in itertools.pairwise(y)))
            total += s
            mass += s * np.array(y)
        want += (mass / total).tolist()
        at += n
    assert chain.marginals(unary, first) == pytest.approx(want, abs=1e-9)


def test_spans_where_lower_case_is_longer():
    text = "İdiot and İdiot"
    hot = {toxicity.tokens(text)[0]: 0.9}
    assert toxicity.spans_of_longer(text, hot) in ([], [{"start": 0, "end": 5, "probability": 0.9}, {"start": 10, "end": 15, "probability": 0.9}])


def test_rules_are_the_same_in_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.random((600, len(STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = fit_rules(x, y)
    z = np.full(len(x), model.intercept)
    for rule, w in model.rules:
        z += w * np.all([x[:, f] <= t if op == "<=" else x[:, f] > t for f, op, t in rule], axis=0)
    assert ((z > 0) == y).mean() > 0.97 and len(model.rules) < 120
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x[:50])], "k int, " + ", ".join(f"{c} double" for c in STATISTICS))
    got = rows.select("k", F.struct(*STATISTICS).alias("s")).select("k", model.column("s").alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == pytest.approx(boosting.sigmoid(z[:50]).tolist(), abs=1e-9)
    assert spark.range(1).select(RuleEnsemble(0.0, []).column("s").alias("p")).first().p == 0.5


def test_statistics_of_odd_texts(spark, documents):
    rows = documents.select(statistics(F.coalesce("text", F.lit(""))).alias("s")).select("s.*").collect()
    assert all(v is not None and math.isfinite(v) for r in rows for v in r)


def test_lasso_drops_what_does_not_tell():
    rng = np.random.default_rng(1)
    x = (rng.random((500, 20)) < 0.5).astype(float)
    b, w = quality.lasso_logistic(x, x[:, 4], 0.01)
    assert w[4] > 1 and np.abs(np.delete(w, 4)).max() < 0.1


PAGE = """<!doctype html><html><head><title>No</title><script>var a = "<p>no</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav><div class="ad">Buy this now. It is cheap.</div>
<article><h1>A &amp; B</h1><p>First paragraph of the text, with   words and
 a line break.<br>It goes on, as paragraphs do, for a while.<p>Second <b>paragraph</b> follows, not closed, and it also has some length.</p></article>
<div id="comments"><div class="comment"><p>I like this text very much, thanks for it. Really.</p></div></div><footer>&copy; Someone, 2026.</footer></body></html>"""


@pytest.fixture(scope="module")
def elements():
    return fit_elements()


def test_extraction(spark, elements):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (1, "u", PAGE, "x"), (4, "u", "<div>" * 3000 + "<p>deep", "x"), (5, "u", "<script>never closed", "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model=elements).collect()
    want = "A & B\n\nFirst paragraph of the text, with words and a line break. It goes on, as paragraphs do, for a while.\n\nSecond paragraph follows, not closed, and it also has some length."
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == want and by[1].n_chars == len(want)
    assert by[2].text == by[3].text == by[5].text == "" and by[2].n_chars == 0


def test_extraction_of_nothing(spark, elements):
    assert extract_main_text(spark.createDataFrame([], "page_id long, html string"), model=elements).collect() == []


def test_extraction_on_pages_not_seen(elements):
    kept = main = right = 0
    for source in sample_pages.pages(80, 123):
        blocks = [b for _, b in dom.parse(source).blocks]
        got = extraction.main_text([source], elements)[0].split("\n\n")
        main += sum(len(b) for b in blocks if sample_pages.told(b) == 1)
        kept += sum(map(len, got))
        right += sum(len(b) for b in got if sample_pages.told(b) == 1)
    assert right / main > 0.93 and right / kept > 0.93


def test_nothing_is_kept_below_what_is_dropped():
    page = dom.parse("<div><p>a</p><div><p>b</p><p>c</p></div></div>")
    for seed in range(40):
        z = np.random.default_rng(seed).normal(size=len(page.nodes)) * 3
        kept = dom.decode(page, z)
        assert kept == [b for _, b in page.blocks if b in kept]


def test_fingerprints(spark, documents, docs, no_documents):
    own = texts(docs)
    rows = {r.doc_id: r for r in fingerprints(documents, rows_per_chunk=7).collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    order, off = sorted(own), []
    seen: dict[str, str] = {}
    for k, i in enumerate(order):
        text, follow = own[i], own[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        a, b = shingles(text), shingles(edited)
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint and len(rows[i].fingerprint) == 256
        off.append(abs(rows[i].near_edited - (len(a & b) / len(a | b) if a | b else 1)))
    assert np.mean(off) < 0.06
    assert fingerprints(no_documents).collect() == []


def test_fingerprints_of_repeated_ids_and_of_one_row(spark):
    one = fingerprints(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_edited < 1 and one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    rows = [(1, "x y"), (1, "a b"), (None, "q"), (2, "")]
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 3 and got[2, 0] == hashlib.sha256(b"").hexdigest() and got[None, 1] == hashlib.sha256(b"q").hexdigest()


def test_fingerprints_of_short_texts_tell_their_likeness(spark):
    r = random.Random(3)
    texts = [" ".join(str(r.randint(0, 10**6)) for _ in range(n)) for n in (5, 6, 8, 12, 20, 40, 200) for _ in range(12)]
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert np.mean([r.near_next for r in rows]) < 0.02


@pytest.mark.parametrize(("count", "most_rows"), [(60, 8192), (300, 150)])
def test_near_vectors(spark, count, most_rows):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(count, 24))
    x = [c + rng.normal(size=24) * s for c in centres for s in ([0.0] * 2 + [0.12] * 5)]
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    odd = [(9000, None, 0), (9001, [0.0] * 24, 0), (9002, [float("nan")] * 24, 0), (9003, [], 0), (9004, [1.0, 2.0], 0), (9005, [2.0, 4.0], 0), (9006, [None] * 24, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors(table, leaf_rows=40 if count == 60 else 4000, block_rows=16 if count == 60 else 64, most_rows=most_rows).collect()}
    m = np.array(x)
    n = np.linalg.norm(m, axis=1)
    near = m @ m.T / n[:, None] / n[None] >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[k].n_links for k in range(len(x)))
    print("recall of links", found / near.sum())
    assert all(got[k].n_links <= near[k].sum() for k in range(len(x))) and found >= 0.9 * near.sum() > 200
    assert all(got[k].n_links == 0 and got[k].kept for k in (9000, 9001, 9002, 9003, 9006))
    assert got[9005].component_id == 9004 and got[9005].n_links == 1 and not got[9005].kept
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_near_vectors_of_repeated_and_null_ids(spark):
    a, b, far = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(5, a), (5, a), (5, far), (3, b), (None, a), (None, [0.0, 0.0, -1.0]), (8, [1e200, 0.0, 1e199])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 4, 3, False), (3, 4, 3, True), (5, 0, 5, True), (5, 4, 3, False), (5, 4, 3, False), (8, 4, 3, False)]
