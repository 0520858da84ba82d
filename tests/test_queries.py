"""Every registered query of the repository part against its SQL, at the smallest scale."""

import os

import pytest

from cairnlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name not in catalogue.oracle_sql():
        assert df.count() > 0
        return
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_diagnostics(spark, sf_dir):
    q = catalogue.queries()
    sealed = q["aead_round_trip"](spark, sf_dir)
    assert sealed.filter("not (opens and rejects_aad and rejects_change)").isEmpty()
    bloom = {(r["member"], r["might_contain"]): r["ids"] for r in q["bloom_diagnostic"](spark, sf_dir).collect()}
    assert (True, False) not in bloom and bloom.get((False, True), 0) <= 0.1 * bloom[False, False]
    assert q["scrub_issues"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
