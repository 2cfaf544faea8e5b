from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, n_lines string, score string"


def corpus(seed: int = 3, count: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared lines and passages, blanks of all kinds, nulls and empty ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [prose(28) for _ in range(3)]
    lines = ["A line that many Documents share", "  a LINE that many documents share\t", "short"]
    docs: list[tuple[int | None, str | None]] = []
    for k in range(count):
        parts = [prose(r.randint(0, 40)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), r.choice(lines))
        docs.append((3 * k + 1, r.choice(["\n", "\n", " ", "\x0b"]).join(parts)))
    docs += [(900 + k, docs[k][1]) for k in range(5)]
    docs += [(950 + k, docs[k + 9][1] + " tail") for k in range(5)]
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "the " * 3000), (1005, "x" * 5000)]
    return docs


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, docs):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "src0", None, "mine", "mine", "mine") for i, t in docs], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return {i: t or "" for i, t in docs}
