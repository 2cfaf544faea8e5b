"""Intermediate tables: where they are, and that they go."""

from __future__ import annotations

from pathlib import Path

import pytest

from meterlake.llm.scratch import Scratch, recorded


def test_tables_are_in_the_shared_folder_until_they_are_released(spark):
    with recorded() as made:
        scratch = Scratch(spark)
        assert scratch.table(spark.range(3)).count() == 3
    assert made == [scratch] and scratch.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    folder = Path(scratch.path.removeprefix("file://"))
    assert folder.exists()
    scratch.release()
    assert not folder.exists()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        Scratch(Session())
