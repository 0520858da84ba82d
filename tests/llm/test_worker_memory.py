"""What Python workers keep for the next stage of the pipeline."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from cairnlake.llm import common, ngramjoin, packing, quality, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["some words of a text that repeat", "", "other words of another text"]


@pytest.fixture
def functions(monkeypatch):
    """The functions that operators hand to the workers."""
    out, run = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: out.append(f) or run(self, f, *a, **b))
    yield out
    tokens._OPEN.clear()


def test_stages_after_packing_drop_its_words(spark, functions):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ngramjoin._sets(docs, 5, 64)
    ngramjoin._token_sets(docs, 5)
    quality._measured(docs, ["doc_id"])
    score = quality._score(quality.Ranker(np.zeros((0, 1)), np.zeros(0, bool))).func
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array(TEXTS), pa.array([0, 1, 2])], ["doc_id", "text", "row"])
    for other in [*functions, lambda batches: score(b.column("text") for b in batches)]:
        packing.pieces(docs, PATH)
        first = list(functions[-1](iter([batch])))
        assert tokens._OPEN and list(functions[-1](iter([batch]))) == first and tokens._OPEN
        assert list(other(iter([batch])))
        assert not tokens._OPEN


def test_what_a_task_took_goes_back_to_the_system():
    def held():
        return next(int(x.split()[1]) for x in Path("/proc/self/status").read_text().split("\n") if x.startswith("RssAnon")) / 1024

    def run(batches):
        for _ in batches:
            blocks = [np.ones(12_000) for _ in range(2000)]  # 192 MB in blocks that the allocator doesn't map one by one
            pins.extend(blocks[99::100])  # in use still, so that what is free lies between
            yield held()

    pins, before = [], held()
    most = max(common.lean(run)(iter(range(2))))
    assert most > before + 150 and held() < before + 80


def test_texts_come_in_batches_of_few_bytes(spark, tmp_path, monkeypatch):
    """Before, all ten long texts of a task came in one batch."""
    monkeypatch.setattr(common, "BATCH", 1 << 20)
    docs = spark.range(10).selectExpr("id doc_id", "repeat('word ', 100000) text").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    before = spark.conf.get(common.BATCH_SETTING)
    got = [r["n"] for r in common.Workspace(spark, "batches").write(docs.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 10 and max(got) <= 3 and spark.conf.get(common.BATCH_SETTING) == before
