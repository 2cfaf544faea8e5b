"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import sigmoid
from .labelled import id_remainder, training_texts
from .names import free_names
from .scratch import Scratch

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
ROW = 256
ERROR = 1e-12


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, and its beginnings (which end in a hyphen)."""
    return [word] + [f"{word[:k]}-" for k in PREFIXES if len(word) >= k]


#: Texts and labels to learn from; each call reads them anew, one after the other.
Rows = Callable[[], Iterator[tuple[str, int]]]


def cue_features(rows: Rows, support: int = 3, precision: float = 0.9, most: int = 2000, chance: float = 0.01) -> set[str]:
    """Features that tell toxic documents: a token of a toxic document is labelled toxic if it has one.

    First those that so many toxic and so few clean documents hold that not one of all features would by
    ``chance``; then, one by one, those that explain most of the toxic documents that are not yet told.
    """
    own = lambda text: {f for w in set(tokens(text)) for f in features(w)}
    lists: dict[str, list[int]] = defaultdict(list)
    toxic = total = 0
    for text, label in rows():
        total += 1
        if label:
            for f in own(text):
                lists[f].append(toxic)
            toxic += 1
    count = len(lists)
    held = {f: set(docs) for f, docs in lists.items() if len(docs) >= support}
    del lists
    clean: Counter[str] = Counter()
    for text, label in rows():
        if not label:
            clean.update(own(text) & held.keys())
    good = {f: docs for f, docs in held.items() if len(docs) >= support and len(docs) >= precision * (len(docs) + clean[f])}
    base = min(max(toxic / total, 1e-3), 0.5) if total else 0.5
    enough = math.log(max(count, 1) / chance) / math.log(1 / base)
    chosen = set(sorted((f for f, docs in good.items() if len(docs) - 3 * clean[f] >= enough), key=lambda f: (-len(good[f]), f))[:most])
    left = set(range(toxic)) - {i for f in chosen for i in good[f]}
    support = max(support, math.ceil(enough / 2))
    order = sorted(good, key=lambda f: (-len(good[f]), len(f), f))
    while order and len(chosen) < most:
        best, kept, top = None, [], 0
        for f in order:
            n = len(good[f] & left)
            if n >= support:
                kept.append(f)
                if n > top:
                    best, top = f, n
        if best is None:
            break
        chosen.add(best)
        left -= good[best]
        order = [f for f in kept if f != best]
    return chosen


@dataclass
class ChainField:
    """Two states, clean (0) and toxic (1). ``step[i][j]`` scores a step from state i to j; unary scores
    are those of state 1 against 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def reach(self) -> int:
        """After so many tokens what lies beyond changes no message by more than ERROR.

        A step contracts ratios of messages by a factor that follows from its four scores (Birkhoff)."""
        shrink = abs(math.tanh((self.step[0, 0] + self.step[1, 1] - self.step[0, 1] - self.step[1, 0]) / 4))
        return 1 if shrink < ERROR else math.ceil(math.log(ERROR) / math.log(min(max(shrink, 1e-9), 1 - 1e-6)))

    def messages(self, unary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward ratios (state 1 over 0) of each token; ``first`` marks starts of documents.

        All documents form one stream, cut into rows of equal length that overlap by reach() at both ends,
        so that the recursion over tokens runs over all rows at once, with work in proportion to the tokens.
        """
        n = len(unary)
        margin = min(self.reach(), int(np.diff(np.flatnonzero(np.append(first, True))).max(initial=1)))  # none beyond the longest document
        width = max(ROW, margin)
        (a, b), (c, d) = np.exp(self.step)
        rows = max(1, -(-n // width))
        at = (np.arange(rows) * width)[:, None] + np.arange(-margin, width + margin)
        inside = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(n - 1, 0))
        e = np.where(inside, np.exp(np.clip(unary, -30, 30))[at], 1.0).T.copy()
        opens = (first[at] | ~inside).T.copy()
        last = np.concatenate([first[1:], [True]])
        closes = (last[at] | ~inside).T.copy()
        forward, backward = np.empty_like(e), np.empty_like(e)
        r = np.full(rows, math.exp(self.start))
        for t in range(len(e)):
            r = e[t] * np.where(opens[t], math.exp(self.start), (b + d * r) / (a + c * r)) if t else e[t] * math.exp(self.start)
            forward[t] = r
        r = np.ones(rows)
        for t in range(len(e) - 1, -1, -1):
            if t < len(e) - 1:
                s = e[t + 1] * r
                r = np.where(closes[t], 1.0, (c + d * s) / (a + b * s))
            backward[t] = r
        cut = slice(margin, margin + width)
        return forward[cut].T.ravel()[:n], backward[cut].T.ravel()[:n]

    def marginals(self, unary: np.ndarray, first: np.ndarray) -> np.ndarray:
        forward, backward = self.messages(unary, first)
        odds = forward * backward
        return odds / (1 + odds)

    def unary(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def stretches_of(cue: np.ndarray, most: int, reach: int = 10) -> list[tuple[int, int]]:
    """Ranges of a text's tokens, ``most`` in all at most: all of a short text; of a longer one the surroundings of
    cues (evenly chosen, half of the tokens) and stretches at even distances."""
    n, width = len(cue), 2 * reach + 1
    if n <= most:
        return [(0, n)] if n else []
    at = np.flatnonzero(cue)
    near = at[np.unique(np.linspace(0, len(at) - 1, min(len(at), most // (2 * width))).astype(int))] - reach if len(at) else at
    spread = np.linspace(0, n - width, max(1, most // width - len(near))).astype(int)
    taken = np.zeros(n + 1, bool)
    for k in [*near.tolist(), *spread.tolist()]:
        taken[max(k, 0) : min(k + width, n)] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], taken[:n], [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def fit_field(rows: Rows, rounds: int = 120, ridge: float = 1e-3, tokens_per_row: int = 128) -> ChainField:
    """Maximum conditional likelihood of the labelled tokens, by Adam on exact gradients.

    Each row gives at most ``tokens_per_row`` tokens (see ``stretches_of``), so that none is left out because
    another is long; a stretch is a chain of its own.
    """
    cues = cue_features(rows)
    if not cues:
        return ChainField()
    vocabulary = {f: k for k, f in enumerate(sorted(cues | {f"{c[:k]}-" for c in cues for k in PREFIXES if len(c.rstrip("-")) >= k}))}
    known: dict[str, tuple[bool, list[int]]] = {}
    docs = []
    for text, label in rows():
        words = tokens(text)
        for w in words:
            if w not in known:
                own = features(w)
                known[w] = any(f in cues for f in own), [vocabulary[f] for f in own if f in vocabulary]
        cue = np.fromiter((known[w][0] for w in words), bool, len(words))
        docs += [(words[a:b], label) for a, b in stretches_of(cue, tokens_per_row)]
        if len(known) > 500_000:
            known = {w: known[w] for words, _ in docs for w in words}
    target = np.array([label and known[w][0] for words, label in docs for w in words], float)
    first = np.concatenate([np.arange(len(words)) == 0 for words, _ in docs])
    token, feature = np.array([(i, k) for i, w in enumerate(w for words, _ in docs for w in words) for k in known[w][1]], np.int64).reshape(-1, 2).T
    inner = ~first
    theta = np.zeros(len(vocabulary) + 6)  # weights, bias, start, step
    theta[len(vocabulary)] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def gathered(state: np.ndarray) -> np.ndarray:
        return np.bincount(feature, state[token], len(vocabulary))

    pairs = lambda s: np.array([(1 - s[:-1]) * (1 - s[1:]), (1 - s[:-1]) * s[1:], s[:-1] * (1 - s[1:]), s[:-1] * s[1:]])[:, inner[1:]].sum(axis=1)
    seen = np.concatenate([gathered(target), [target.sum(), target[first].sum()], pairs(target)])
    scale = 1 / max(target.sum(), 1)
    for k in range(1, rounds + 1):
        w, field_now = theta[: len(vocabulary)], ChainField(start=theta[len(vocabulary) + 1], step=theta[len(vocabulary) + 2 :].reshape(2, 2))
        unary = theta[len(vocabulary)] + np.bincount(token, w[feature], len(target))
        forward, backward = field_now.messages(unary, first)
        p = forward * backward / (1 + forward * backward)
        u, r, b = np.exp(np.clip(unary[1:], -30, 30)), forward[:-1], backward[1:]
        s = np.exp(field_now.step)
        joint = np.array([s[0, 0] + 0 * r, s[0, 1] * u * b, r * s[1, 0], r * s[1, 1] * u * b])
        joint = (joint / joint.sum(axis=0))[:, inner[1:]].sum(axis=1)
        gradient = (seen - np.concatenate([gathered(p), [p.sum(), p[first].sum()], joint])) * scale - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = {f: float(theta[k]) for f, k in vocabulary.items()}
    return ChainField(weights, float(theta[len(vocabulary)]), float(theta[len(vocabulary) + 1]), theta[len(vocabulary) + 2 :].reshape(2, 2).copy())


class Unaries(dict):
    """Unary scores of words, kept for the next time; cleared at ``limit`` entries."""

    def __init__(self, chain: ChainField, limit: int = 500_000):
        super().__init__()
        self.chain, self.limit = chain, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        score = self[word] = self.chain.unary(word)
        return score


def evidence(marginals: list[np.ndarray]) -> np.ndarray:
    """Of each document: the largest marginal, the log of one plus their sum, and their mean."""
    return np.array([[m.max(), math.log1p(m.sum()), m.mean()] if len(m) else [0.0, 0.0, 0.0] for m in marginals]).reshape(-1, 3)


def document_marginals(chain: ChainField, texts: list[str], known: Unaries) -> list[np.ndarray]:
    unary = [np.fromiter(map(known.__getitem__, words), np.float64, len(words)) for words in map(tokens, texts)]
    lengths = np.array([len(u) for u in unary], np.int64)
    if not lengths.sum():
        return unary
    first = np.zeros(lengths.sum(), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return np.split(chain.marginals(np.concatenate(unary), first), np.cumsum(lengths)[:-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Intercept and weights by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 4,
    held_out: int = 2,
    threshold: float = 0.3,
    max_rows: int = 8_000,
    tokens_per_row: int = 128,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add held_out, score (0 to 1, higher: the label 1 is likelier), predicted (1 from ``threshold``) and
    spans (array of start, end, probability: words whose marginal is 0.5 or more, in code points).

    Learns from at most ``max_rows`` labelled ids whose CRC-32 leaves another remainder than ``held_out``,
    and reads nothing but the text. The field is fitted to ``tokens_per_row`` tokens of each such row at most;
    all else reads its whole text. The driver reads these rows one partition after the other. Tokens of toxic documents are labelled by features that only these
    hold; the field is fitted to the labelled tokens, and marginals of its forward-backward pass become a
    document's score by a logistic fit to the labels. A null text scores as an empty one. Without a label
    of either kind the score is one constant. Repeated rows score alike; other columns pass through,
    except that input columns of the four names are replaced. An empty table gives no rows.
    """
    spark = documents.sparkSession
    sample = (scratch or Scratch(spark)).table(training_texts(documents, labels, label_col, modulus, held_out, max_rows, id_col, text_col))

    def rows() -> Iterator[tuple[str, int]]:
        return ((r["_text"], r["_y"]) for r in sample.toLocalIterator())

    chain = fit_field(rows, tokens_per_row=tokens_per_row)
    told, y, known = [], [], Unaries(chain)
    for text, label in rows():
        told.append(evidence(document_marginals(chain, [text], known)))
        y.append(label)
    model = spark.sparkContext.broadcast((chain, logistic(np.concatenate(told), np.array(y, float)) if y else np.zeros(4)))

    @F.arrow_udf("struct<score: double, spans: array<struct<start: int, end: int, probability: double>>>")
    def scored(text_column: pa.Array) -> pa.Array:
        chain, w = model.value
        known, out = Unaries(chain), []
        for k in range(0, len(text_column), 200):
            texts = [t.as_py() or "" for t in text_column[k : k + 200]]
            marginals = document_marginals(chain, texts, known)
            scores = sigmoid(w[0] + evidence(marginals) @ w[1:])
            for text, m, s in zip(texts, marginals, scores.tolist(), strict=True):
                hot, spans = np.flatnonzero(m >= 0.5).tolist(), []
                if hot and len(text.lower()) == len(text):
                    at = [x.span() for x in WORD.finditer(text.lower())]
                    spans = [{"start": at[i][0], "end": at[i][1], "probability": float(m[i])} for i in hot]
                elif hot:
                    spans = spans_of_longer(text, {tokens(text)[i]: float(m[i]) for i in hot})
                out.append({"score": s, "spans": spans})
        return pa.array(out, SCORED)

    (out,) = free_names(documents, "_out")
    return (
        documents.withColumn(out, scored(F.col(text_col)))
        .withColumn("held_out", id_remainder(F.col(id_col), modulus) == held_out)
        .withColumn("score", F.col(f"{out}.score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .withColumn("spans", F.col(f"{out}.spans"))
        .drop(out)
    )


SCORED = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])


def spans_of_longer(text: str, hot: dict[str, float]) -> list[dict]:
    """Spans in a text whose lower case has another length: words are lowered one by one."""
    return [{"start": x.start(), "end": x.end(), "probability": hot[x.group().lower()]} for x in WORD.finditer(text) if x.group().lower() in hot]
