"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import pytest

from ledgerlens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = df.select(*(f"`{n}`" for n in names)).collect()
    want = duck.sql(registry.oracle_sql()[name])
    at = [want.columns.index(n) for n in names]
    assert len(want.columns) == len(names)
    assert plain(got) == plain([tuple(r[k] for k in at) for r in want.fetchall()])


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_texts_are_normalised_once(spark):
    from ledgerlens.plans import q_text

    for rows in (q_text.lines(spark, DATA), q_text.dataset(spark, DATA)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["classifier_naive_bayes", "classifier_contamination", "classifier_logistic"])
def test_classifiers_without_any_usable_text(spark, tmp_path, name):
    """Copies of a part whose codes disagree leave no text to train or test with."""
    duckdb = pytest.importorskip("duckdb")
    from pyspark.sql import functions as F

    part = spark.read.parquet(f"{DATA}/part.parquet").limit(20)
    part.crossJoin(spark.range(12).select(F.col("id").alias("r"))).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("r")).drop("r").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    if name in registry.oracle_sql():
        c = duckdb.connect()
        c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
        assert plain(got) == plain(c.sql(registry.oracle_sql()[name]).fetchall())
    else:
        assert got == [(None, None, None, None, None)]
