"""The main text of web pages: boosted trees over page elements, decoded as a hierarchy."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, dom, sample_pages

Model = tuple[float, list[boosting.Tree]]


@cache
def fit_elements(count: int = 700, seed: int = 5, trees: int = 60, depth: int = 4) -> Model:
    """Learn from ``count`` made-up pages. An element is main text if most text below it is.

    Equal arguments give the same model, which is fitted once in a process."""
    rows, labels = [], []
    for source in sample_pages.pages(count, seed):
        page = dom.parse(source)
        main, all_ = [0] * len(page.nodes), [0] * len(page.nodes)
        for node, text in page.blocks:
            main[node] += len(text) * (sample_pages.told(text) == 1)
            all_[node] += len(text)
        for k in range(len(main) - 1, 0, -1):
            main[page.nodes[k].parent] += main[k]
            all_[page.nodes[k].parent] += all_[k]
        has = np.array(all_) > 0
        rows.append(dom.features(page)[has])
        labels.append((2 * np.array(main) > np.array(all_))[has])
    return boosting.fit(np.concatenate(rows).astype(float), np.concatenate(labels).astype(float), trees, depth, rate=0.2, bins=48, share=0.7)


def main_text(pages: list[str], model: Model) -> list[str]:
    parsed = [dom.parse(p) for p in pages]
    features = [dom.features(p) for p in parsed]
    odds = boosting.log_odds(model, np.concatenate(features).astype(float)) if features else np.zeros(0)
    cuts = np.cumsum([len(f) for f in features])[:-1]
    return ["\n\n".join(dom.decode(p, z)) for p, z in zip(parsed, np.split(odds, cuts) if features else [], strict=True)]


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Add ``text_col``, the main text of the page, and n_chars, its code points.

    Blocks of text stand in page order, two newlines apart; character references are decoded and white
    space within a block is one space. A null or empty page, or one without text, gives an empty text.
    Repeated rows give the same; other columns pass through, except that columns of the two names are
    replaced. An empty table gives no rows. The model is fitted by the driver on made-up pages (a fixed
    number, see ``fit_elements``) and is a few hundred kilobytes; each page is read whole, alone.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit_elements())

    @F.arrow_udf("string")
    def texts(sources: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(sources), 64):
            out += main_text([s or "" for s in sources[k : k + 64].to_pylist()], shared.value)
        return pa.array(out, pa.string())

    return pages.withColumn(text_col, texts(html_col)).withColumn("n_chars", F.char_length(text_col).cast("long"))
