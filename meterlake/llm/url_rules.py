"""Verdicts on URLs: given rules, else rules mined by FP-growth from labelled URLs. DataFrame functions only."""

from __future__ import annotations

import json
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("allow", "block")
HASHES = 1 << 20
SLOTS = 256


class Rule(NamedTuple):
    """Fits its host and all subdomains, if the path starts with ``path``."""

    host: str
    path: str
    verdict: str


def _constant(value: object, kind: str) -> Column:
    """A nested value as a constant, which the optimizer folds to one object for the whole query."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty without one."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = lambda group: F.coalesce(F.regexp_extract(url, parts, group), F.lit(""))
    return F.translate(found(1), string.ascii_uppercase, string.ascii_lowercase), found(2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does; of equally long ones the longer host's."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    told = lambda r: F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(none, *[F.when(fits(r), told(r)) for r in ordered])


def url_tokens(url: Column) -> Column:
    """Distinct tokens of the whole URL: labels of the host, the last of them apart, path segments with their
    place, the first digit of those that begin with one, and names in the query string. A null URL has none."""
    host, path = host_and_path(url)
    named = lambda items, prefix: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    labels = F.split(host, r"\.")
    segments = F.split(F.ltrim(path, F.lit("/")), "/")
    placed = F.filter(F.transform(segments, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"] != "")
    whole = F.transform(placed, lambda x: F.concat(F.lit("path"), x["i"].cast("string"), F.lit("="), x["s"]))
    starts = F.transform(F.filter(placed, lambda x: x["s"].rlike("^[0-9]")), lambda x: F.concat(F.lit("path"), x["i"].cast("string"), F.lit("^"), F.left(x["s"], F.lit(1))))
    query = F.split(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit("")), "&")
    names = F.transform(query, lambda q: F.substring_index(q, "=", 1))
    last = named(F.array(F.element_at(labels, -1)), "tld=")
    others = named(F.slice(labels, 1, F.size(labels) - 1), "host=")
    return F.array_distinct(F.concat(others, last, whole, starts, named(names, "query=")))


def labelled_sample(urls: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` of the rows (url, verdict, and ``_id``, which only tells rows apart), those of the least hashes.

    A threshold on the hash thins the rows out where they lie, so what meets for the final cut is about
    ``max_rows``, unless a larger part of all rows are exact copies."""
    h = F.pmod(F.xxhash64("url", "_id"), F.lit(HASHES))
    share = min(1.0, 1.1 * max_rows / max(1, urls.count()) + 1e-3)
    near = urls.where(h < int(share * HASHES))
    return near.orderBy(F.xxhash64("url", "_id"), "url", "_id", "verdict").limit(max_rows).select("url", "verdict")


class MinedRule(NamedTuple):
    """Says ``verdict`` of URLs that have all ``items``; ``anchor`` is the rarest of them, ``slot`` its place in the index."""

    items: list[str]
    verdict: str
    confidence: float
    support: float
    anchor: str
    slot: int


def mined_rules(
    labelled: DataFrame,
    min_support: float = 0.01,
    min_rows: int = 5,
    min_confidence: float = 0.8,
    most_tokens: int = 10,
    most_rules: int = 1000,
) -> tuple[list[MinedRule], str]:
    """Rules that FP-growth mines, best first, and the verdict of URLs that none of them fits.

    ``labelled`` has url and verdict, a bounded number of rows. A transaction is a URL's tokens and its
    verdict. Tokens in less than ``min_support`` of the rows, or in fewer than ``min_rows``, can be in no rule
    and are left out; of the others a transaction has the ``most_tokens`` whose share of block differs most
    from that of all rows, weighed by their count, so no URL has more than 2^most_tokens combinations. A
    rule no surer than one with a token less is dropped. Rules rank by confidence, support, brevity, block
    before allow, and text; at most ``most_rules`` are kept, which bounds what is collected and broadcast.
    Where no rule fits, the commoner verdict holds (allow if equal, or without labelled rows).
    """
    rows = labelled.where(F.col("verdict").isin(*VERDICTS)).select(url_tokens(F.col("url")).alias("tokens"), "verdict").cache()
    counts = dict(rows.groupBy("verdict").count().collect())
    n, blocked = sum(counts.values()), counts.get("block", 0)
    default = "block" if 2 * blocked > n else "allow"
    if n < min_rows:
        return [], default
    least = max(min_support, min_rows / n)
    tokens = rows.select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").cast("long").alias("b"))
    told = tokens.groupBy("token").agg(F.count("*").alias("count"), F.sum("b").alias("b")).where(F.col("count") >= least * n)
    weight = F.abs(F.col("b") * n - F.col("count") * blocked)
    frequent = {t.token: t["count"] for t in told.orderBy(weight.desc(), "token").collect()}
    own = F.slice(F.array_intersect(_constant(list(frequent), "array<string>"), F.col("tokens")), 1, most_tokens)
    transactions = rows.select(F.concat(own, F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(transactions)

    told_of = F.array(*[F.lit(f"verdict={v}") for v in VERDICTS])
    of_verdicts = F.arrays_overlap("consequent", told_of) & ~F.arrays_overlap("antecedent", told_of)
    said = F.substring_index(F.get("consequent", F.lit(0)), "=", -1).alias("verdict")
    found = model.associationRules.where(of_verdicts).select(F.sort_array("antecedent").alias("items"), said, "confidence", "support").cache()
    one_less = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.filter("items", lambda _, k: k != i))
    longer = found.select("items", "verdict", "confidence", F.explode(one_less).alias("_less"))
    shorter = found.select(F.col("items").alias("_less"), "verdict", F.col("confidence").alias("_sure"))
    useless = longer.join(shorter, ["_less", "verdict"]).where("_sure >= confidence").select("items", "verdict")
    best = found.join(useless, ["items", "verdict"], "left_anti")
    rarity = F.transform("items", lambda x: F.struct(F.element_at(_constant(frequent, "map<string,long>"), x), x.alias("x")))
    ranked = best.withColumn("anchor", F.array_min(rarity)["x"])
    ranked = ranked.withColumn("slot", F.pmod(F.xxhash64("anchor"), F.lit(SLOTS)).cast("int"))
    rank = [F.col("confidence").desc(), F.col("support").desc(), F.size("items"), F.col("verdict").desc(), F.array_join("items", " ")]
    rules = [MinedRule(*r) for r in ranked.orderBy(*rank).limit(most_rules).collect()]
    found.unpersist()
    rows.unpersist()
    return rules, default


def mined_verdict(url: Column, rules: Sequence[MinedRule], default: str) -> Column:
    """The verdict of the best rule whose items a URL all has, else ``default``.

    An inverted index has each rule under its anchor alone: a URL looks up its tokens and checks the other items of
    what it finds. The index is one constant of the plan (``most_rules`` bounds it), looked up where the URL
    is read; nothing shuffles.
    """
    slots: list[list[dict[str, object]]] = [[] for _ in range(SLOTS)]
    for rank, rule in enumerate(rules):
        slots[rule.slot].append({"rank": rank, "verdict": rule.verdict, "anchor": rule.anchor, "items": rule.items})
    index = _constant(slots, "array<array<struct<rank:int,verdict:string,anchor:string,items:array<string>>>>")

    def fitting(tokens: Column) -> Column:
        def found(token: Column) -> Column:
            listed = F.get(index, F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int"))
            return F.filter(listed, lambda p: (p["anchor"] == token) & F.forall(p["items"], lambda x: F.array_contains(tokens, x)))

        return F.array_min(F.flatten(F.transform(tokens, found)))["verdict"]

    return F.coalesce(F.get(F.transform(F.array(url_tokens(url)), fitting), F.lit(0)), F.lit(default))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labelled: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    max_rows: int = 100_000,
    **mining: float,
) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``.

    The longest given rule that fits decides. Other URLs get the verdict of rules mined from ``labelled``
    (url, verdict; without it from the URLs that the given rules decide) by at most ``max_rows`` of its rows; see
    ``mined_rules`` for ``mining``. A null URL, or one without ``://``, has an empty host and path, fits no
    rule and no token, and gets the commoner verdict. Repeated rows and null ids are judged like all
    others; an empty table gives no rows; other columns are not read. The verdict takes the whole URL.
    """
    host, path = host_and_path(F.col(url_col))
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    decided = longest_rule(host, path, rules)
    if labelled is None:
        labelled = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), decided["verdict"].alias("verdict")).where("verdict IS NOT NULL")
    else:
        labelled = labelled.select(F.lit(None).cast("long").alias("_id"), "url", "verdict")
    mined, default = mined_rules(labelled_sample(labelled, max_rows), **mining)
    host, path = host_and_path(F.col("url"))
    placed = read.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = placed.withColumn("_ruled", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_ruled.verdict"), mined_verdict(F.col("url"), mined, default))
    return ruled.select("page_id", "host", "path", F.col("_ruled.rule").alias("rule"), verdict.alias("verdict"))
