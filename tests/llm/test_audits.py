"""URL verdicts and the audit of filters against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations, permutations

import pytest

from meterlake.llm.filter_audit import filter_interactions
from meterlake.llm.queries import URL_RULES
from meterlake.llm.url_rules import Rule, judge_urls

FLAGGED = {
    "A": lambda words, text: len(words) < 100,
    "B": lambda words, text: 100 * len(set(words)) < 80 * len(words),
    "C": lambda words, text: 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
    "D": lambda words, text: re.search(r"[#$%&*|]", text) is not None,
}


def audited(docs, labels):
    """Every row of the audit by replaying each document through each order."""
    firsts, parts, rows = {}, set(), Counter()
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for i, text, lang in docs:
        text, part = text or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, test in FLAGGED.items() if test(words, text)} | ({"E"} if i is not None and i > firsts[text] else set())
        parts.add(part)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, c in enumerate(order, 1):
                at, bad = (part, order, step), c in fails
                rows[at, "redundant"] += bad and gone
                rows[at, "unique_fails"] += fails == {c}
                if bad and not gone:
                    gone = True
                    rows[at, "removed"] += 1
                    rows[at, "good_lost"] += i in good
                    rows[at, "toxic_lost"] += i in toxic
                    rows[(part, c), "shapley"] += 1
                rows[at, "kept"] += not gone
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    every = [(p, o, s) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)]
    return {at: (*[rows[at, n] for n in names], rows[(at[0], at[1][at[2] - 1]), "shapley"]) for at in every}


def audit_fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdXYé") for _ in range(r.randint(1, 6)))
    docs = []
    for k in range(60):
        words = [word() for _ in range(r.choice([0, 3, 99, 100, 101, 130]))]
        if r.random() < 0.4:
            words = [r.choice(words[:30] or ["x"]) for _ in words]
        text = r.choice([" ", "\n", "\x0b "]).join(words) + r.choice(["", "", "#", "|"])
        docs.append((k, text.lower() if r.random() < 0.6 else text, r.choice(["en", "de", None, ""])))
    docs += [(100 + k, docs[k][1], "fr") for k in range(9)] + [(3, docs[3][1], "en"), (3, docs[3][1], "en"), (None, docs[4][1], "en"), (None, None, None), (200, None, "en"), (201, "", "en")]
    docs += [(300, "long Word " * 40_000, "en"), (301, "\u00a0 \t" * 50, "en")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 70, 2)] + [(3, 1, 0), (3, None, 1), (None, 1, 1), (100, None, None)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def test_audit(spark):
    docs, labels = audit_fixture()
    documents = spark.createDataFrame([(*d, "x", "x") for d in docs], "doc_id long, text string, lang string, part string, fails string").repartition(3)
    got = filter_interactions(documents, spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, step int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    want = audited(docs, labels)
    assert len(rows) == len(want) == 600 * 4
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == want


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interactions(none, labels).count() == 0
    assert filter_interactions(spark.createDataFrame([(1, "a", None)], none.schema), labels).count() == 600


def split_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return re.sub("[A-Z]", lambda c: c[0].lower(), host), path


def ruled(url, rules):
    host, path = split_url(url)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)


def tokens(url):
    host, path = split_url(url)
    *labels, last = host.split(".")
    found = [f"host={x}" for x in labels if x] + [f"tld={last}"] * bool(last)
    for i, s in enumerate(path.lstrip("/").split("/")):
        found += [f"path{i}={s}"] * bool(s) + [f"path{i}^{s[:1]}"] * (s[:1].isdigit())
    query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", url or "")
    return set(found + [f"query={q.split('=')[0]}" for q in query[1].split("&") if q.split("=")[0]] if query else found)


def mined(labelled, min_rows=5, min_support=0.01, min_confidence=0.8, most_tokens=10):
    """All rules by counting every combination of every row's tokens, best first, and the default."""
    n, blocked = len(labelled), sum(v == "block" for _, v in labelled)
    least = max(min_support, min_rows / n) * n
    count, b = Counter(), Counter()
    for url, v in labelled:
        for t in tokens(url):
            count[t] += 1
            b[t] += v == "block"
    vocabulary = sorted((t for t in count if count[t] >= least), key=lambda t: (-abs(b[t] * n - count[t] * blocked), t))
    both, alone = Counter(), Counter()
    for url, v in labelled:
        own = [t for t in vocabulary if t in tokens(url)][:most_tokens]
        for size in range(1, len(own) + 1):
            for items in combinations(sorted(own), size):
                alone[items] += 1
                both[items, v] += 1
    rules = [(items, v, k / alone[items], k / n) for (items, v), k in both.items() if k >= least and k / alone[items] >= min_confidence]
    rules.sort(key=lambda r: (-r[2], -r[3], len(r[0]), r[1] != "block", " ".join(r[0])))
    return rules, "block" if 2 * blocked > n else "allow"


def judged(urls, rules):
    labelled = [(u, ruled(u, rules).verdict) for u in urls if ruled(u, rules)]
    found, default = mined(labelled) if len(labelled) >= 5 else ([], "allow")
    told = []
    for u in urls:
        rule = ruled(u, rules)
        best = next((v for items, v, *_ in found if set(items) <= tokens(u)), default)
        told.append((*split_url(u), rule and rule.host + rule.path, rule.verdict if rule else best))
    return told


def url_fixture():
    r = random.Random(8)
    hosts = ["a.example.org", "blog.example.org", "www.b.example.com", "B.Example.Com", "x.example.net", "spam.example.net", "example.org", "org", "notorg"]
    paths = ["/en/1", "/en/2/a", "/es/", "/es", "/de/5", "/fr/7.html", "//de/", "", "/en/12//z"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?page=2&ref=x', '#top', '?utm=1#a?b'])}" for _ in range(300)]
    return [*urls, None, "", "no scheme/at all", "x://", "http://?q=1", "a://b.org://c.com/de/1", "http://example.org/es/" + "y/" * 30_000, "http://" + "n." * 5_000 + "com/de/"]


def test_urls(spark):
    urls = url_fixture()
    rows = list(enumerate(urls)) + [(None, urls[0]), (7, urls[7]), (7, urls[7])]
    pages = spark.createDataFrame([(*x, "h", "v", "r") for x in rows], "page_id long, url string, host string, verdict string, rule string").repartition(3)
    got = judge_urls(pages, URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = judged([u for _, u in rows], URL_RULES)
    assert Counter(map(tuple, got.collect())) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    undecided = {w[3] for w in want if w[2] is None}
    assert undecided == {"allow", "block"}


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, []).orderBy("page_id").collect()] == [(1, "a.org", "/x", None, "allow"), (2, "", "", None, "allow")]
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_urls_by_given_labels(spark):
    labelled = [(f"http://{h}.net/{k}", v) for k in range(30) for h, v in (("good", "allow"), ("bad", "block"))] + [("http://bad.net/q", None)]
    pages = spark.createDataFrame([(1, "http://www.bad.net/q"), (2, "http://good.net/"), (3, "http://good.org/")], "page_id long, url string")
    got = judge_urls(pages, [Rule("org", "/", "block")], spark.createDataFrame(labelled, "url string, verdict string"))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: (None, "block"), 2: (None, "allow"), 3: ("org/", "block")}


@pytest.mark.parametrize("max_rows", [40, 1000])
def test_sample_of_labels_is_bounded(spark, max_rows):
    from meterlake.llm.url_rules import labelled_sample

    rows = spark.range(500).selectExpr("id AS _id", "concat('http://a.org/', id) AS url", "'allow' AS verdict")
    assert 30 <= labelled_sample(rows, max_rows).count() <= max_rows
