"""What Python workers hold once a task is over."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

from meterlake.llm import workers
from meterlake.llm.packing import pack


def test_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append(1))
    twice = workers.frugal(lambda batches: (b for x in batches for b in (x, x)))
    one = pa.record_batch([pa.array([1])], ["x"])
    assert list(twice(iter([one, one]))) == [one] * 4 and calls == [1]
    stopped = twice(iter([one, one]))
    next(stopped)
    stopped.close()
    assert calls == [1, 1]


def test_memory_can_go_back():
    workers.give_back()


def test_idle_workers_of_packing_hold_no_words(spark):
    docs = spark.createDataFrame([(k, f"some plain words and number{k}") for k in range(40)], "doc_id long, text string").repartition(4)
    assert pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 40

    def held(batches):
        from meterlake.llm import packing

        for batch in batches:
            yield pa.record_batch([pa.array([sum(map(len, packing._LOADED.values()))] * len(batch), pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 400, 1, 4).mapInArrow(held, "n long").collect()} == {0}
