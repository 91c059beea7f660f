"""The driver's star-schema tables in the roles that the operators expect, as DataFrames
and as the same SQL. Declared lines are those numbered up to 3, realised ones from 2 on;
codes are eight digits derived from the part, and some are blanked on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code8(x: Column) -> Column:
    return F.lpad(((x * 48611) % 100000000).cast("string"), 8, "0")


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def _coded() -> Column:
    return code8(F.when(F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") % 2000).otherwise(F.col("l_partkey")))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    return rows.select(F.col("l_orderkey").alias("key"), "l_linenumber", F.when(F.col("l_orderkey") % 37 != 0, _coded()).alias("code"), money(F.col("l_extendedprice")).alias("amount"))


def realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber >= 2")
    return rows.select(
        F.col("l_orderkey").alias("key"), "l_linenumber", F.when((F.col("l_orderkey") % 41 != 0) & (F.col("l_orderkey") % 74 != 0), _coded()).alias("code"), money(F.col("l_extendedprice")).alias("amount")
    )


_CODE = "lpad(CAST((CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey % 2000 ELSE l_partkey END) * 48611 % 100000000 AS VARCHAR), 8, '0')"
DECLARED = f"SELECT l_orderkey AS key, l_linenumber, CASE WHEN l_orderkey % 37 <> 0 THEN {_CODE} END AS code, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem WHERE l_linenumber <= 3"
REALISED = f"SELECT l_orderkey AS key, l_linenumber, CASE WHEN l_orderkey % 41 <> 0 AND l_orderkey % 74 <> 0 THEN {_CODE} END AS code, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem WHERE l_linenumber >= 2"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order's year, mechanism, entity and status; some prices equal
    the quantity (a capture error), some keys and mechanisms are missing."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    k = F.col("l_orderkey")
    rows = li.join(o, k == F.col("o_orderkey"))
    error = (k % 997 == 0) & (F.col("l_linenumber") == 1)
    return rows.select(
        k.alias("doc"),
        F.col("l_linenumber").alias("line"),
        F.year("o_orderdate").alias("year"),
        F.year("l_shipdate").alias("ship_year"),
        F.when(k % 53 != 0, F.col("o_orderpriority")).alias("mechanism"),
        F.when(k % 3 != 0, F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("K-"), (k % 4000).cast("string")))).alias("key"),
        F.col("l_suppkey").alias("entity"),
        F.col("o_custkey").alias("unit"),
        F.col("l_returnflag").alias("flag"),
        F.when(k % 7 == 0, "USD").otherwise("CLP").alias("currency"),
        F.when(k % 29 == 0, F.lit("ZGEN0001")).when(k % 31 == 0, F.lit(None)).otherwise(code8(F.col("l_partkey"))).alias("code"),
        F.when(error, 250000.0 + k).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(error, 250000.0 + k).otherwise(F.col("l_extendedprice")).alias("price"),
        money(F.when(error, (250000.0 + k) * 1000).otherwise(F.col("l_extendedprice"))).alias("amount"),
        money(F.col("o_totalprice")).alias("doc_total"),
        F.when(F.col("l_linestatus") == "F", "kg").otherwise("unit").alias("measure"),
    )


LINES = """SELECT l_orderkey AS doc, l_linenumber AS line, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
  CASE WHEN l_orderkey % 53 <> 0 THEN o_orderpriority END AS mechanism,
  CASE WHEN l_orderkey % 3 <> 0 THEN CASE WHEN l_orderkey % 11 = 0 THEN ' ' ELSE 'K-' || (l_orderkey % 4000) END END AS key,
  l_suppkey AS entity, o_custkey AS unit, l_returnflag AS flag,
  CASE WHEN l_orderkey % 7 = 0 THEN 'USD' ELSE 'CLP' END AS currency,
  CASE WHEN l_orderkey % 29 = 0 THEN 'ZGEN0001' WHEN l_orderkey % 31 = 0 THEN NULL ELSE lpad(CAST(l_partkey * 48611 % 100000000 AS VARCHAR), 8, '0') END AS code,
  CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1 THEN 250000.0 + l_orderkey ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1 THEN 250000.0 + l_orderkey ELSE l_extendedprice END AS price,
  CAST(CASE WHEN l_orderkey % 997 = 0 AND l_linenumber = 1 THEN (250000.0 + l_orderkey) * 1000 ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
  CAST(o_totalprice AS DECIMAL(18,2)) AS doc_total,
  CASE WHEN l_linestatus = 'F' THEN 'kg' ELSE 'unit' END AS measure
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that lines can link to: those of orders that are not open."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    return o.select(F.concat(F.lit("K-"), (F.col("o_orderkey") % 4000).cast("string")).alias("key"))


TENDERS = "SELECT 'K-' || (o_orderkey % 4000) AS key FROM orders WHERE o_orderstatus <> 'O'"


def snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Two downloads of the same orders: each lacks some rows and some fields."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    gone = (k % 13 == 0) if version == 1 else (k % 17 == 0)
    date = F.when(k % (5 if version == 1 else 9) != 0, F.date_add(F.col("o_orderdate").cast("date"), (k % 200).cast("int")))
    supplier = F.when(k % (4 if version == 1 else 7) == 0, F.lit("S/I")).otherwise(F.concat(F.lit("P"), F.col("o_custkey").cast("string")))
    return o.where(~gone).select(
        k.alias("key"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderdate").cast("date").alias("published"),
        F.when(k % 211 == 0, F.to_date(F.lit("1900-01-01"))).otherwise(date).alias("awarded"), supplier.alias("supplier"),
        (k % (3 if version == 1 else 4)).cast("int").alias("bidders"), F.col("o_orderstatus").alias("status"), F.date_add(F.col("o_orderdate").cast("date"), (k % 100 * 2).cast("int")).alias("estimated"),
    )


def snapshot_sql(version: int) -> str:
    gone, d, s, b = (13, 5, 4, 3) if version == 1 else (17, 9, 7, 4)
    return f"""SELECT o_orderkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_orderdate AS DATE) AS published,
  CASE WHEN o_orderkey % 211 = 0 THEN DATE '1900-01-01' WHEN o_orderkey % {d} <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) END AS awarded,
  CASE WHEN o_orderkey % {s} = 0 THEN 'S/I' ELSE 'P' || o_custkey END AS supplier, CAST(o_orderkey % {b} AS INTEGER) AS bidders, o_orderstatus AS status,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 100 * 2 AS INTEGER) AS estimated
FROM orders WHERE o_orderkey % {gone} <> 0"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines with a free text, a code, a year and a mechanism."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("id"), (F.lit(2017) + k % 8).cast("int").alias("year"), F.col("source").alias("mechanism"), code8(k % 97).alias("code"), F.col("lang").alias("label"),
        F.when(k % 19 == 0, F.lit("segun bases")).when(k % 23 == 0, F.lit(" . ")).when(k % 31 == 0, F.concat(F.lit("Item "), code8(k % 97))).when(k % 37 == 0, F.lit("Insumo general")).otherwise(F.col("text")).alias("text"),
        (k % 1000 + 1).cast("decimal(18,2)").alias("amount"),
    )


TEXTS = """SELECT doc_id AS id, CAST(2017 + doc_id % 8 AS INTEGER) AS year, source AS mechanism, lpad(CAST(doc_id % 97 * 48611 % 100000000 AS VARCHAR), 8, '0') AS code, lang AS label,
  CASE WHEN doc_id % 19 = 0 THEN 'segun bases' WHEN doc_id % 23 = 0 THEN ' . ' WHEN doc_id % 31 = 0 THEN 'Item ' || lpad(CAST(doc_id % 97 * 48611 % 100000000 AS VARCHAR), 8, '0')
       WHEN doc_id % 37 = 0 THEN 'Insumo general' ELSE text END AS text,
  CAST(doc_id % 1000 + 1 AS DECIMAL(18,2)) AS amount FROM documents"""
