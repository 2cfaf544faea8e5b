"""A quality classifier: a sparse ensemble of rules over statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .labelled import id_remainder, training_texts
from .names import free_names

#: Columns of the statistics, in the order of a rule's feature numbers.
STATISTICS = ("chars", "word_chars", "upper", "symbols", "pipes", "bangs", "digits", "stops", "distinct_words", "distinct_lines", "line_words", "longest_word")


def statistics(text: Column) -> Column:
    """A struct of STATISTICS over the whole text; shares and ratios are 0 for a text without words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")

    def told(t: Column, w: Column, ls: Column) -> Column:
        chars, n = F.char_length(t), F.size(w)
        per_char = lambda c: c / F.greatest(chars, F.lit(1))
        per_word = lambda c: c / F.greatest(n, F.lit(1))
        return F.struct(
            chars.cast("double").alias("chars"),
            per_word(F.char_length(t)).alias("word_chars"),
            per_char(F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))).alias("upper"),
            per_word(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"|-]+"))).alias("symbols"),
            per_word(F.regexp_count(t, F.lit(r"\|"))).alias("pipes"),
            per_word(F.regexp_count(t, F.lit(r"!+"))).alias("bangs"),
            per_word(F.regexp_count(t, F.lit(r"\d+"))).alias("digits"),
            per_word(F.regexp_count(t, F.lit(r"[.?!](?=\s|$)"))).alias("stops"),
            per_word(F.size(F.array_distinct(w))).alias("distinct_words"),
            (F.size(F.array_distinct(ls)) / F.size(ls)).alias("distinct_lines"),
            (n / F.size(ls)).alias("line_words"),
            F.coalesce(F.array_max(F.transform(w, F.char_length)), F.lit(0)).cast("double").alias("longest_word"),
        )

    # One array of one element binds the text and its parts to names, so that each is made once.
    bound = F.transform(F.array(F.struct(text.alias("t"), words.alias("w"), lines.alias("l"))), lambda x: told(x["t"], x["w"], x["l"]))
    return F.get(bound, F.lit(0))


@dataclass
class RuleEnsemble:
    """score = sigmoid(intercept + the weights of the rules that hold); a rule is a conjunction."""

    intercept: float
    rules: list[tuple[tuple[tuple[int, str, float], ...], float]]

    def column(self, stat: str) -> Column:
        holds = {"<=": lambda c, t: c <= t, ">": lambda c, t: c > t}
        terms = [F.when(reduce(lambda a, b: a & b, [holds[op](F.col(f"{stat}.{STATISTICS[f]}"), F.lit(t)) for f, op, t in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return F.lit(1.0) / (F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))) + 1.0)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps."""
    n, m = x.shape
    step = 4 * n / max(np.linalg.norm(np.column_stack([x, np.ones(n)]), 2) ** 2, 1e-9)
    w, b = np.zeros(m), 0.0
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = boosting.sigmoid(x @ v + c) - y
        w2 = v - step * (x.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4) -> RuleEnsemble:
    """Rules are the distinct paths of boosted trees; the lasso keeps few of them."""
    prior, grown = boosting.fit(x, y, trees, depth, rate=0.3, share=0.5)
    seen: dict[bytes, tuple] = {}
    for path in (p for tree in grown for p in tree.paths()):
        holds = np.ones(len(x), bool)
        for f, op, t in path:
            holds &= x[:, f] <= t if op == "<=" else x[:, f] > t
        if 0.002 < holds.mean() < 0.998:
            kept = seen.get(holds.tobytes())
            seen[holds.tobytes()] = min(path, kept, key=len) if kept else path
    if not seen:
        return RuleEnsemble(prior, [])
    matrix = np.stack([np.frombuffer(k, bool) for k in seen], axis=1).astype(float)
    intercept, weights = lasso_logistic(matrix, y, penalty)
    return RuleEnsemble(float(intercept), [(rule, float(w)) for rule, w in zip(seen.values(), weights, strict=True) if w])


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 3,
    held_out: int = 1,
    max_rows: int = 20_000,
) -> DataFrame:
    """Add held_out, score (0 to 1, higher: the label 1 is likelier) and predicted (1 from a score of 0.5).

    Learns from at most ``max_rows`` labelled ids whose CRC-32 leaves another remainder than ``held_out``,
    and reads nothing but the text. A null text scores as an empty one. Without labels of both kinds each
    document gets the share of 1 (0.5 without any). Repeated rows score alike; other columns pass
    through, except that input columns of the three names are replaced. An empty table gives no rows.

    Statistics and the fitted rules are Spark columns, so that scoring is a projection of the scan.
    """
    sample = training_texts(documents, labels, label_col, modulus, held_out, max_rows, id_col, text_col)
    rows = sample.select(statistics(F.col("_text")).alias("_stats"), "_y").select("_stats.*", "_y").toPandas()
    model = fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float))
    (stats,) = free_names(documents, "_stats")
    return (
        documents.withColumn(stats, statistics(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn("held_out", id_remainder(F.col(id_col), modulus) == held_out)
        .withColumn("score", model.column(stats))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .drop(stats)
    )
