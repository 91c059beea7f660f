"""Reading partitions and raw files, and what can be said of them before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.clean import coerced, parse_failed, percent
from ..operators.link import union_all


def read_partition(spark: SparkSession, base: str, category: str, year: int) -> DataFrame:
    """One partition of ``base/category=*/year=*``, pruned by its folder names."""
    return spark.read.parquet(base).where((F.col("category") == category) & (F.col("year") == year))


def read_years(spark: SparkSession, base: str, categories: dict[int, str]) -> DataFrame:
    """All years, each from its category, with provenance columns; columns that a year lacks
    are NULL."""
    frames = []
    for year, category in sorted(categories.items()):
        one = spark.read.option("basePath", base).parquet(f"{base}/category={category}/year={year}")
        frames.append(one.drop("category", "year").withColumn("_category", F.lit(category)).withColumn("_year", F.lit(year)))
    return union_all(frames)


def row_gate(rows: DataFrame, part: str, expected: DataFrame) -> DataFrame:
    """Per partition: actual and expected rows (part, expected), their difference, and
    whether it is none. Partitions that only one side has show up."""
    actual = rows.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("actual"))
    j = actual.join(expected, "part", "full_outer").fillna(0, ["actual", "expected"])
    d = F.col("actual") - F.col("expected")
    return j.withColumn("delta", d).withColumn("delta_pct", F.round(percent(d, F.col("expected")), 6)).withColumn("ok", d == 0)


def require(gate: DataFrame, column: str = "ok") -> None:
    """Raises unless every row of a gate passes."""
    bad = gate.where(~F.coalesce(F.col(column), F.lit(False))).limit(20).collect()
    if bad:
        raise ValueError(f"gate not passed: {[r.asDict() for r in bad]}")


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV with a header, under a schema that is given and not guessed."""
    return spark.read.schema(schema).csv(path, header=True)


def read_catalogue(spark: SparkSession, path: str, code: str, texts: list[str], digits: int = 8, family: int = 6) -> DataFrame:
    """A catalogue CSV as text: zero-padded code, family prefix, and a search document."""
    c = F.lpad(F.trim(code), digits, "0")
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("code", c).withColumn("family", F.substring(c, 1, family)).withColumn("document", F.concat_ws(" ", *texts))


def read_raw(spark: SparkSession, path: str, columns: list[str], sep: str = ";", encoding: str = "ISO-8859-1", header: bool = True) -> DataFrame:
    """Raw monthly files, all columns text, with the file's path and the malformed line where
    a row has too few or too many fields."""
    # without all columns the parser would not see that a row has too many or too few fields
    schema = StructType([StructField(c, StringType()) for c in columns] + [StructField("_malformed", StringType())])
    rows = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed", columnPruning=False).csv(path, sep=sep, header=header, encoding=encoding)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def conform(raw: DataFrame, aliases: dict[str, str], target: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows in the target columns and types, one row of failed casts for each column).
    Columns that the raw frame lacks are NULL; the failures come from one aggregate."""
    have = {aliases.get(c, c): c for c in raw.columns}
    typed, failed = [], []
    for name, kind in target.items():
        if name in have:
            value = coerced(F.col(have[name]), kind)
            typed.append(value.alias(name))
            failed.append(F.struct(F.lit(name).alias("column"), F.sum(parse_failed(F.col(have[name]), value)).alias("failed")))
        else:
            typed.append(F.lit(None).cast("boolean" if kind == "bool" else kind).alias(name))
            failed.append(F.struct(F.lit(name).alias("column"), F.lit(None).cast("long").alias("failed")))
    return raw.select(*typed), raw.agg(F.array(*failed).alias("f")).select(F.inline("f"))


def malformed_rows(raw: DataFrame) -> DataFrame:
    """Per file: rows, malformed rows, and rows with a stray carriage return inside."""
    stray = F.lit(False)
    for c in raw.columns:
        if not c.startswith("_"):
            stray = stray | F.coalesce(F.col(c).contains("\r"), F.lit(False))
    file = F.substring_index("_file", "/", -1)
    return raw.withColumn("_stray", stray).groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.count("_malformed").alias("malformed"), F.count_if("_stray").alias("stray_returns"))


def period_of(path: Column) -> dict[str, Column]:
    """Year and month in a path: of the folder if it tells, else of the file name; and
    whether the two disagree."""
    number = lambda c: F.when(c != "", c).try_cast("int")
    folder = F.regexp_extract(path, r"(\d{4})[-_/](\d{1,2})/[^/]*$", 0)
    fy, fm = number(F.regexp_extract(folder, r"^(\d{4})", 1)), number(F.regexp_extract(folder, r"^\d{4}[-_/](\d{1,2})/", 1))
    name = F.substring_index(path, "/", -1)
    ny, nm = number(F.regexp_extract(name, r"(\d{4})[-_](\d{1,2})(?!\d)", 1)), number(F.regexp_extract(name, r"(\d{4})[-_](\d{1,2})(?!\d)", 2))
    differ = (fy.isNotNull() & ny.isNotNull()) & ((fy != ny) | (fm != nm))
    source = F.when(fy.isNotNull(), "folder").when(ny.isNotNull(), "name").otherwise("none")
    return {"year": F.coalesce(fy, ny), "month": F.when(fy.isNotNull(), fm).otherwise(nm), "source": source, "disagrees": F.coalesce(differ, F.lit(False))}


def missing_months(rows: DataFrame, year: str, month: str) -> DataFrame:
    """(year, month) that a year with any row lacks."""
    seen = rows.select(F.col(year).alias("year"), F.col(month).alias("month")).where("year is not null").distinct()
    every = seen.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return every.join(seen, ["year", "month"], "left_anti")


def schema_table(rows: DataFrame, name: str) -> DataFrame:
    """(part, position, column, type) of a frame."""
    spark = rows.sparkSession
    return spark.createDataFrame([(name, k, f.name, f.dataType.simpleString()) for k, f in enumerate(rows.schema.fields)], "part string, position int, column string, type string")


def schema_conformance(one: DataFrame, other: DataFrame) -> DataFrame:
    """Differences of two schemas: columns that one lacks, other types, other places."""
    a, b = schema_table(one, "a").drop("part"), schema_table(other, "b").drop("part")
    j = a.join(b.select("column", F.col("position").alias("p2"), F.col("type").alias("t2")), "column", "full_outer")
    what = F.when(F.col("p2").isNull(), "missing").when(F.col("position").isNull(), "extra").when(F.col("type") != F.col("t2"), "type").when(F.col("position") != F.col("p2"), "order")
    return j.select("column", what.alias("difference"), F.col("type").alias("type_before"), F.col("t2").alias("type_after")).where("difference is not null")


def filled_columns(rows: DataFrame) -> DataFrame:
    """(column, n_filled) in one pass."""
    return rows.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("n_filled")) for c in rows.columns)).alias("c")).select(F.inline("c"))


def file_inventory(rows: DataFrame, part: str, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """Per partition: files, rows, bytes, bytes a row, and whether that is far from the
    median partition's. Read the frame from files: it uses their metadata."""
    f = rows.select(F.col(part).alias("part"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).groupBy("part", "f").agg(F.max("s").alias("s"), F.count("*").alias("n"))
    g = f.groupBy("part").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"), F.sum("s").alias("n_bytes"))
    g = g.withColumn("bytes_per_row", F.try_divide("n_bytes", "n_rows"))
    m = g.agg(F.median("bytes_per_row").alias("m"))
    ratio = F.try_divide(F.col("bytes_per_row"), F.col("m"))
    return g.join(m).withColumn("outlier", (ratio < low) | (ratio > high)).drop("m")
