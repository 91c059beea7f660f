"""Sources and sinks over files that the tests write."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import resolve
from ledgerlens.sources import readers, sinks


def test_partitions_and_provenance(spark, tmp_path):
    base = str(tmp_path / "t")
    spark.range(5).withColumn("category", F.lit("old")).withColumn("year", F.lit(2020)).write.partitionBy("category", "year").parquet(base)
    spark.range(3).withColumn("more", F.lit("x")).withColumn("category", F.lit("now")).withColumn("year", F.lit(2021)).write.mode("append").partitionBy("category", "year").parquet(base)
    one = readers.read_partition(spark, base, "old", 2020)
    assert one.count() == 5
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    both = readers.read_years(spark, base, {2020: "old", 2021: "now"})
    assert both.groupBy("_year").count().orderBy("_year").collect()[1]["count"] == 3 and "more" in both.columns


def test_row_gate(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "p int")
    gate = readers.row_gate(rows, "p", spark.createDataFrame([(1, 2), (3, 4)], "part int, expected int"))
    assert {r.part: (r.delta, r.ok) for r in gate.collect()} == {1: (0, True), 2: (1, False), 3: (-4, False)}
    with pytest.raises(ValueError, match="gate"):
        readers.require(gate)


def test_raw_files(spark, tmp_path):
    folder = tmp_path / "2024-03"
    folder.mkdir()
    (folder / "lic_2024-04.csv").write_bytes("código;monto;fecha\na;1.234,5;01-05-2024\nb;x;0\nshort\nc;1;2;3;4\n".encode("latin-1"))
    raw = readers.read_raw(spark, str(tmp_path / "*"), ["code", "amount", "day"])
    r = readers.malformed_rows(raw.cache()).first()
    assert (r.file, r.n, r.malformed) == ("lic_2024-04.csv", 4, 2)
    rows, failed = readers.conform(raw.where("_malformed is null"), {"amount": "total"}, {"code": "string", "total": "double", "day": "date", "absent": "int"})
    assert [x.total for x in rows.collect()] == [1234.5, None] and {x.column: x.failed for x in failed.collect()} == {"code": 0, "total": 1, "day": 1, "absent": None}
    p = readers.period_of(F.col("_file"))
    got = raw.select(*(c.alias(n) for n, c in p.items())).first()
    assert (got.year, got.month, got.source, got.disagrees) == (2024, 3, "folder", True)


def test_inventory_and_schema(spark, tmp_path):
    base = str(tmp_path / "p")
    spark.range(1000).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(base)
    inv = readers.file_inventory(spark.read.parquet(base), "part").collect()
    assert sum(r.n_rows for r in inv) == 1000 and not any(r.outlier for r in inv)
    a, b = spark.createDataFrame([], "x int, y string, z int"), spark.createDataFrame([], "y string, x long, w int")
    assert {r.column: r.difference for r in readers.schema_conformance(a, b).collect()} == {"x": "type", "y": "order", "z": "missing", "w": "extra"}


def test_months(spark):
    rows = spark.createDataFrame([(2020, m) for m in range(1, 12)], "y int, m int")
    assert [tuple(r) for r in readers.missing_months(rows, "y", "m").collect()] == [(2020, 12)]


def test_catalogue_and_lookup(spark, tmp_path):
    (tmp_path / "c.csv").write_text("CodigoProducto,NombreProducto\n123,Silla\n")
    r = readers.read_catalogue(spark, str(tmp_path / "c.csv"), "CodigoProducto", ["NombreProducto"]).first()
    assert (r.code, r.family, r.document) == ("00000123", "000001", "Silla")
    assert readers.read_lookup(spark, str(tmp_path / "c.csv"), "code int, name string").first().code == 123


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    assert sinks.sanitised(df).columns == ["a_b", "a_b_2"]
    sinks.write_partitioned(spark.range(10).withColumn("y", F.col("id") % 2), str(tmp_path / "o"), ["y"])
    assert spark.read.parquet(str(tmp_path / "o")).where("y = 1").count() == 5
    assert sinks.materialised(spark.range(4), str(tmp_path / "m")).count() == 4
    sinks.write_summary(spark, str(tmp_path / "s"), {"rows": 3})
    assert spark.read.json(str(tmp_path / "s")).first().rows == "3"
    tables = {"t": (spark.range(3), "three rows")}
    ok = sinks.control(spark.range(3), F.count("*"), 3, 0)
    m = sinks.gated_export(ok, tables, str(tmp_path / "e"), "run1").first()
    assert (m.table, m.n_rows, m.run) == ("t", 3, "run1")
    with pytest.raises(ValueError, match="gate"):
        sinks.gated_export(sinks.control(spark.range(3), F.count("*"), 4, 0), tables, str(tmp_path / "f"), "run2")
    assert not (tmp_path / "f").exists()


def test_columns_by_alias(spark):
    assert resolve.resolve(["Código OC", "x"], ["codigo_oc"]) == "Código OC"
    assert resolve.resolve(["Código OC final"], ["codigo_oc"]) is None
    col, warning = resolve.resolve_loosely(["Código OC final"], ["codigo_oc"])
    assert col == "Código OC final" and "in part" in warning
    assert resolve.resolve_loosely(["codigo_oc_a", "codigo_oc_b"], ["codigo_oc"])[0] is None
    df = spark.createDataFrame([(1, 2)], "Monto int, z int")
    assert resolve.canonical(df, {"amount": ["monto"]}).columns == ["amount", "_unmapped_z"]
    with pytest.raises(ValueError, match="missing"):
        resolve.against_target(df, {"q": "int"})
    assert resolve.against_target(df, {"z": "long", "q": "int"}, True, True).first().z == 2
