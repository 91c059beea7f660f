"""Queries of sources, schemas and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link as L
from ..operators import resolve as R
from ..sources import readers, sinks
from .registry import query
from .standin import lines, table


@query("""WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS part, count(*) AS actual FROM orders GROUP BY 1), e AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS part, count(*) + CASE WHEN CAST(year(o_orderdate) AS INTEGER) = 1998 THEN 5 ELSE 0 END AS expected FROM orders WHERE year(o_orderdate) < 2001 GROUP BY 1)
SELECT part, coalesce(actual, 0) AS actual, coalesce(expected, 0) AS expected, coalesce(actual, 0) - coalesce(expected, 0) AS delta, CASE WHEN coalesce(expected, 0) > 0 THEN round(100.0 * (coalesce(actual, 0) - expected) / expected, 6) END AS delta_pct, coalesce(actual, 0) = coalesce(expected, 0) AS ok FROM a FULL JOIN e USING (part)""")
def partition_row_gate(spark, sf_dir):
    """Actual against expected rows per partition."""
    o = table(spark, sf_dir, "orders").withColumn("part", F.year("o_orderdate"))
    e = o.where("part < 2001").groupBy("part").agg((F.count("*") + F.when(F.col("part") == 1998, 5).otherwise(0)).alias("expected"))
    return readers.row_gate(o, "part", e)


@query("""WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders), y AS (SELECT DISTINCT year FROM m)
SELECT year, CAST(mm AS INTEGER) AS month FROM y, range(1, 13) r(mm) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.year = y.year AND m.month = mm)""")
def month_completeness(spark, sf_dir):
    """The months that a year lacks."""
    return readers.missing_months(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")), "y", "m")


@query("""WITH p AS (SELECT CASE WHEN event_id % 3 = 0 THEN '/in/2024-' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') || '/lic_2024-' || (event_id % 7 + 1) || '.csv' WHEN event_id % 3 = 1 THEN '/in/x/oc_2023_' || (event_id % 12 + 1) || '.csv' ELSE '/in/x/other.csv' END AS f, event_id FROM events),
q AS (SELECT CASE WHEN event_id % 3 = 0 THEN 2024 WHEN event_id % 3 = 1 THEN 2023 END AS year, CASE WHEN event_id % 3 < 2 THEN event_id % 12 + 1 END AS month, CASE event_id % 3 WHEN 0 THEN 'folder' WHEN 1 THEN 'name' ELSE 'none' END AS source, event_id % 3 = 0 AND event_id % 12 <> event_id % 7 AS disagrees FROM p)
SELECT year, CAST(month AS INTEGER) AS month, source, disagrees, count(*) AS n FROM q GROUP BY ALL""")
def period_from_path(spark, sf_dir):
    """Year and month from folder or file name, and where they disagree."""
    k = F.col("event_id")
    f = F.when(k % 3 == 0, F.concat(F.lit("/in/2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/lic_2024-"), (k % 7 + 1).cast("string"), F.lit(".csv"))).when(k % 3 == 1, F.concat(F.lit("/in/x/oc_2023_"), (k % 12 + 1).cast("string"), F.lit(".csv"))).otherwise("/in/x/other.csv")
    p = readers.period_of(F.col("f"))
    return table(spark, sf_dir, "events").select(f.alias("f")).select(*(c.alias(n) for n, c in p.items())).groupBy("year", "month", "source", "disagrees").agg(F.count("*").alias("n"))


@query()
def file_inventory(spark, sf_dir):
    """Files, bytes and bytes a row of the tables, and outliers."""
    names = ("orders", "lineitem", "customer", "part", "documents")
    frames = [table(spark, sf_dir, n).withColumn("part", F.lit(n)) for n in names]
    one = [f.select("part", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")) for f in frames]
    rows = L.union_all([x.groupBy("part", "f").agg(F.max("s").alias("s"), F.count("*").alias("n")) for x in one])
    g = rows.groupBy("part").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"), F.sum("s").alias("n_bytes")).withColumn("bytes_per_row", F.try_divide("n_bytes", "n_rows"))
    m = g.agg(F.median("bytes_per_row").alias("m"))
    ratio = F.col("bytes_per_row") / F.col("m")
    return g.join(m).select("part", "n_files", "n_rows", (ratio.between(0.6, 1.6)).alias("usual"))


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_totalprice) IS NOT NULL AS BOOLEAN) AS filled, count(DISTINCT o_custkey) AS n_entities, round(sum(o_totalprice), 2) AS total, 'a_b,amount,entity,key' AS kept FROM orders""")
def canonical_columns(spark, sf_dir):
    """Aliased columns under canonical names and target types."""
    o = table(spark, sf_dir, "orders")
    drifted = o.withColumnRenamed("o_totalprice", "Monto Total").withColumnRenamed("o_custkey", "COD_CLIENTE")
    named = R.canonical(drifted, {"key": ["o_orderkey"], "amount": ["MontoTotal", "monto"], "entity": ["cod cliente"]})
    rows = R.against_target(named, {"key": "long", "amount": "double", "entity": "long"}, drop_extra=True)
    rows = sinks.sanitised(rows.withColumn("a b", F.lit(1)).withColumnRenamed("a b", "a b "))
    value = R.either(F.lit(" "), F.col("amount").cast("string"))
    return rows.agg(F.count("*").alias("n"), F.bool_or(value.isNotNull()).alias("filled"), F.count_distinct("entity").alias("n_entities"), F.round(F.sum("amount"), 2).alias("total"), F.lit(",".join(sorted(rows.columns))).alias("kept"))


@query("SELECT value, expected, abs(value - expected) <= 0.5 AS ok FROM (SELECT CAST(count(*) AS DOUBLE) AS value, CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS expected FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def export_control(spark, sf_dir):
    """The control value that an export waits for."""
    n = table(spark, sf_dir, "lineitem").count()
    return sinks.control(lines(spark, sf_dir), F.count("*"), float(n), 0.5)


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, 1 AS old FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT o_orderstatus, NULL, count(*), NULL FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1")
def union_with_missing_columns(spark, sf_dir):
    """Frames of different columns, united by name."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    a = o.where("o_orderkey % 2 = 0").groupBy("status", "priority").agg(F.count("*").alias("n"), F.lit(1).alias("old"))
    return L.union_all([a, o.where("o_orderkey % 2 = 1").groupBy("status").agg(F.count("*").alias("n"))])


def _raw(spark, sf_dir):
    """Orders as a raw monthly CSV in latin-1 with semicolons, some amounts unreadable, some
    rows a field short or long."""
    k = F.col("o_orderkey")
    amount = F.when(k % 17 == 0, "s/d").otherwise(F.concat((k % 1000).cast("string"), F.lit(","), F.lpad((k % 100).cast("string"), 2, "0")))
    day = F.when(k % 13 == 0, "0").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    line = F.concat_ws(";", k.cast("string"), amount, day, F.lit("ñandú"))
    line = F.when(k % 101 == 0, F.concat_ws(";", k.cast("string"), amount)).when(k % 103 == 0, F.concat(line, F.lit(";more"))).otherwise(line)
    path = sinks.scratch(spark, "raw")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.option("encoding", "ISO-8859-1").text(path)
    schema_free = readers.read_raw(spark, path, ["key", "Monto", "day", "name"], header=False)
    return schema_free


_BAD = "(o_orderkey % 101 = 0 OR o_orderkey % 103 = 0)"


@query(f"""SELECT 'amount' AS "column", count(*) FILTER (WHERE NOT {_BAD} AND o_orderkey % 17 = 0) AS failed FROM orders UNION ALL SELECT 'date', count(*) FILTER (WHERE NOT {_BAD} AND o_orderkey % 13 = 0) FROM orders
UNION ALL SELECT 'key', 0 UNION ALL SELECT 'name', 0 UNION ALL SELECT 'absent', NULL""")
def raw_csv_failed_casts(spark, sf_dir):
    """Raw CSV to target types, with the failed casts of each column."""
    good = _raw(spark, sf_dir).where("_malformed is null")
    target = {"key": "bigint", "amount": "double", "date": "date", "name": "string", "absent": "int"}
    return readers.conform(good, {"Monto": "amount", "day": "date"}, target)[1]


@query(f"""SELECT CAST(o_orderkey % 7 AS INTEGER) AS k, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 1000 * 100 + o_orderkey % 100 END) AS BIGINT) AS cents, count(*) FILTER (WHERE o_orderkey % 13 <> 0) AS n_dates
FROM orders WHERE NOT {_BAD} GROUP BY 1""")
def raw_csv_conversion(spark, sf_dir):
    """What the converted rows hold."""
    good = _raw(spark, sf_dir).where("_malformed is null")
    rows, _ = readers.conform(good, {"Monto": "amount", "day": "date"}, {"key": "bigint", "amount": "decimal(18,2)", "date": "date"})
    return rows.groupBy((F.col("key") % 7).cast("int").alias("k")).agg(F.count("*").alias("n"), (F.sum("amount") * 100).cast("bigint").alias("cents"), F.count("date").alias("n_dates"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_BAD}) AS malformed, CAST(0 AS BIGINT) AS stray_returns FROM orders")
def malformed_rows(spark, sf_dir):
    """Rows of raw files with too few or too many fields."""
    g = readers.malformed_rows(_raw(spark, sf_dir))
    return g.agg(*(F.sum(c).alias(c) for c in ("n", "malformed", "stray_returns")))


@query("""SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'history' ELSE 'current' END AS category, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END) AS n_priority FROM orders GROUP BY 1, 2""")
def partitioned_years(spark, sf_dir):
    """Yearly partitions written by category, read back with provenance;
    the older ones lack a column."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    base = sinks.scratch(spark, "years")
    years = [r.year for r in o.select("year").distinct().collect()]
    for category, rows in (("history", o.where("year < 1998").drop("o_orderpriority")), ("current", o.where("year >= 1998"))):
        sinks.write_partitioned(rows, f"{base}/category={category}", ["year"])
    back = readers.read_years(spark, base, {y: "history" if y < 1998 else "current" for y in years})
    return back.groupBy(F.col("_category").alias("category"), F.col("_year").alias("year")).agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("n_priority"))


@query("""WITH c AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_name || ' ' || p_brand AS document FROM part) SELECT substr(code, 1, 6) AS family, count(*) AS n, CAST(sum(length(document)) AS BIGINT) AS n_chars FROM c GROUP BY 1""")
def catalogue_from_csv(spark, sf_dir):
    """A catalogue CSV with padded codes, families and search documents."""
    path = sinks.scratch(spark, "catalogue")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.csv(path, header=True)
    c = readers.read_catalogue(spark, path, "p_partkey", ["p_name", "p_brand"])
    return c.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("document")).alias("n_chars"))


@query("""SELECT 'by_status' AS "table", (SELECT count(DISTINCT o_orderstatus) FROM orders) AS n_rows, 'orders by status' AS description, 'run' AS run UNION ALL SELECT 'by_priority', (SELECT count(DISTINCT o_orderpriority) FROM orders), 'orders by priority', 'run'""")
def export_manifest(spark, sf_dir):
    """Result tables as CSV with a manifest, let out by a control value."""
    o = table(spark, sf_dir, "orders")
    tables = {"by_status": (o.groupBy("o_orderstatus").count(), "orders by status"), "by_priority": (o.groupBy("o_orderpriority").count(), "orders by priority")}
    path = sinks.scratch(spark, "export")
    sinks.write_summary(spark, f"{path}/summary", {"rows": o.count()})
    return sinks.gated_export(sinks.control(o, F.count("*"), float(o.count()), 0), tables, path, "run").drop("written")


@query("SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, count(o_orderpriority) AS n_priority FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def one_partition(spark, sf_dir):
    """One partition by category and year, pruned by its folders."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    base = sinks.scratch(spark, "partition")
    sinks.write_partitioned(o.withColumn("category", F.when(F.col("year") < 1998, "history").otherwise("current")), base, ["category", "year"])
    return readers.read_partition(spark, base, "history", 1996).groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("n_priority"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(DISTINCT month(o_orderdate)) AS BIGINT) AS n_months, CAST(sum(o_orderkey % 100) AS DOUBLE) AS total FROM orders GROUP BY 1")
def lookup_under_schema(spark, sf_dir):
    """A monthly lookup CSV with a header, under a given schema."""
    path = sinks.scratch(spark, "lookup")
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.sum(F.col("o_orderkey") % 100).cast("double").alias("index"))
    o.write.csv(path, header=True)
    return readers.read_lookup(spark, path, "year int, month int, index double").groupBy("year").agg(F.count("month").alias("n_months"), F.sum("index").alias("total"))


@query("""SELECT 'o_orderstatus' AS "column", 'missing' AS difference, 'string' AS type_before, NULL AS type_after, (SELECT count(o_orderstatus) FROM orders) AS filled_before, NULL::BIGINT AS filled_after
UNION ALL SELECT 'o_custkey', 'type', 'bigint', 'string', (SELECT count(o_custkey) FROM orders), (SELECT count(o_custkey) FROM orders) UNION ALL SELECT 'note', 'extra', NULL, 'string', NULL, (SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) FROM orders)
UNION ALL SELECT 'o_totalprice', 'order', 'double', 'double', (SELECT count(o_totalprice) FROM orders), (SELECT count(o_totalprice) FROM orders) UNION ALL SELECT 'o_orderdate', 'order', 'timestamp', 'timestamp', (SELECT count(o_orderdate) FROM orders), (SELECT count(o_orderdate) FROM orders)
UNION ALL SELECT 'o_orderpriority', 'order', 'string', 'string', (SELECT count(o_orderpriority) FROM orders), (SELECT count(o_orderpriority) FROM orders)""")
def schema_differences(spark, sf_dir):
    """Two downloads whose columns, types and order differ, with their filled values."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    later = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_totalprice", "o_orderdate", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "x").alias("note"))
    d = readers.schema_conformance(o, later)
    counts = [readers.filled_columns(x).withColumnRenamed("n_filled", f"filled_{w}") for x, w in ((o, "before"), (later, "after"))]
    return d.join(counts[0], "column", "left").join(counts[1], "column", "left")


@query("""SELECT 'key' AS field, 'o_orderkey' AS "column", NULL AS warning, (SELECT count(o_orderkey) FROM orders) AS n_filled UNION ALL SELECT 'amount', 'o_totalprice', chr(39) || 'Total Price' || chr(39) || ' matched ' || chr(39) || 'o_totalprice' || chr(39) || ' in part only', (SELECT count(o_totalprice) FROM orders)
UNION ALL SELECT 'status', NULL, chr(39) || 'order' || chr(39) || ' matches 4 columns in part', NULL UNION ALL SELECT 'tax', NULL, 'none of [' || chr(39) || 'vat' || chr(39) || '] found', NULL""")
def announced_partial_match(spark, sf_dir):
    """R2: columns found exactly, in part (which is announced), ambiguously or not at all."""
    return R.resolution(table(spark, sf_dir, "orders"), {"key": ["O_ORDERKEY"], "amount": ["Total Price"], "status": ["order"], "tax": ["vat"]})
