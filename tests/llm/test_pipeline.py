"""The pipeline's stages on the small tables, each against plain Python on its own input."""

from collections import Counter

import public_tokenizers
import pytest
from brute import WORD, jaccard_components, lower_bound, mix_targets

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        done = f(spark, docs, sf_dir).cache()
        out.append((name, docs, done))
        docs = done
    yield {name: (before, after) for name, before, after in out}
    spark.catalog.clearCache()


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(stages):
    assert list(stages) == ["quality", "exact", "near", "mixing", "packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_filters(stages):
    before, after = stages["quality"]
    assert 0 < after.count() < before.count() and set(pairs(after)) <= set(pairs(before))
    before, after = map(pairs, stages["exact"])
    assert sorted(after) == sorted((max(d for d, t in before if t == text), text) for text in {t for _, t in before})
    before, after = map(pairs, stages["near"])
    assert sorted(d for d, _ in after) == sorted(d for d, _, c in jaccard_components(before) if c == d)


def test_mixing_and_packing(stages):
    before, after = stages["mixing"]
    size, got = Counter(), Counter()
    for df, sums in ((before, size), (after, got)):
        for r in df.select("source", "text").collect():
            sums[r[0]] += len(WORD.findall(r[1]))
    assert got == Counter({s: int(t + 1e-6) for s, t in mix_targets(size).items() if int(t + 1e-6)})
    texts, packed = stages["packing"]
    rows = packed.collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(d for d, _ in pairs(texts))
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * lower_bound([r["length"] for r in rows]) + 1


def test_run(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select(*columns).collect())
    assert got == sorted(tuple(r) for r in stages["packing"][1].select(*columns).collect())
    assert public_tokenizers.path(corpus_pipeline.TOKENIZER)
