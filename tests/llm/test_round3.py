"""What the findings on the second round were about."""

import pytest
from test_llm import rows

from cairnlake.llm import common, ngramjoin
from cairnlake.llm.common import Workspace


@pytest.fixture
def finely_dealt(spark):
    """Shuffles in 97 partitions that Spark doesn't put together."""
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_tables_of_the_ngram_join_in_few_files(spark, monkeypatch, finely_dealt):
    """However finely shuffles are dealt, what is written of a few documents takes a few tasks; before, up to 97."""
    files, write = {}, Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: files.setdefault(name, (out := write(self, df, name)).rdd.getNumPartitions() and len(out.inputFiles())) and out or out)
    docs = [(i, " ".join(f"w{i % 40}x{k}" for k in range(30)) + (f" end{i}" if i % 3 else "")) for i in range(200)]
    got = dict((d, c) for d, _, c in rows(ngramjoin.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert got == {i: i % 40 for i in range(200)}
    most = 2 * spark.sparkContext.defaultParallelism
    assert most < 97 and {"classes", "copies", "first-pairs", "first-judged", "roots-of-classes"} <= set(files) and any(name.startswith("first-roots-step") for name in files)
    made_of_texts = {"sets", "documents", "texts", *(f"{r}-{t}" for r in ("first", "second") for t in ("keys", "tokens", "meetings"))}
    assert {name: n for name, n in files.items() if n > most and name not in made_of_texts} == {}


def test_parts_grow_with_the_rows(spark):
    most, df = 2 * spark.sparkContext.defaultParallelism, spark.range(100).repartition(97)
    assert [common.in_parts(df, n, 10).rdd.getNumPartitions() for n in (0, 10 * (most + 4), 10**9)] == [most, most + 5, 97]
