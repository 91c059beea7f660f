"""Queries of the link operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link as L
from ..operators import money as M
from .registry import query
from .standin import LINES, TENDERS, lines, snapshot, snapshot_sql, table, tenders

_LINKED = f"""l AS ({LINES}), k AS (SELECT DISTINCT upper(trim(key)) AS k FROM ({TENDERS}) WHERE trim(key) <> ''),
j AS (SELECT l.*, k.k IS NOT NULL AS linked FROM l LEFT JOIN k ON nullif(upper(trim(l.key)), '') = k.k)"""


def linked_lines(spark, sf_dir):
    return L.link(lines(spark, sf_dir), tenders(spark, sf_dir), "key", "key")


@query(f"WITH {_LINKED} SELECT (SELECT count(*) FROM l) AS n_before, (SELECT count(*) FROM j) AS n_after, (SELECT count(*) FROM l) = (SELECT count(*) FROM j) AS kept")
def link_cardinality(spark, sf_dir):
    """A link keeps the number of lines."""
    return L.cardinality_kept(lines(spark, sf_dir), linked_lines(spark, sf_dir))


@query(f"WITH {_LINKED} SELECT mechanism, count(*) AS n, count(*) FILTER (WHERE linked) AS n_flag, round(100.0 * count(*) FILTER (WHERE linked) / count(*), 6) AS pct FROM j GROUP BY mechanism")
def link_coverage_by_group(spark, sf_dir):
    """A2: linked lines by mechanism."""
    return L.coverage(linked_lines(spark, sf_dir), "mechanism", F.col("linked"))


@query(f"""WITH {_LINKED}, c AS (SELECT unit % 50 AS g, round(100.0 * count(*) FILTER (WHERE linked) / count(*), 6) AS pct FROM j GROUP BY 1) SELECT g FROM c WHERE pct < 58""")
def structural_groups(spark, sf_dir):
    """A3: groups whose coverage is under a limit, found in the data."""
    rows = linked_lines(spark, sf_dir).withColumn("g", F.col("unit") % 50)
    return L.structural_groups(L.coverage(rows, "g", F.col("linked")), "g", 58.0)


@query(f"""WITH {_LINKED}, c AS (SELECT mechanism, 100.0 * count(*) FILTER (WHERE linked) / count(*) AS pct FROM j GROUP BY 1), s AS (SELECT mechanism FROM c WHERE round(pct, 6) < 60),
m AS (SELECT j.*, s.mechanism IS NULL AS usual, coalesce(trim(key) <> '', false) AS has FROM j LEFT JOIN s USING (mechanism)),
d AS (SELECT doc, bool_or(linked) AS any_linked FROM m GROUP BY doc)
SELECT count(*) AS n_lines, count(DISTINCT doc) AS n_docs, round(100.0 * count(*) FILTER (WHERE linked) / count(*), 6) AS line_rate, round(100.0 * count(*) FILTER (WHERE linked) / count(*) FILTER (WHERE has), 6) AS keyed_rate,
  round(100.0 * count(*) FILTER (WHERE linked AND usual) / count(*) FILTER (WHERE usual), 6) AS usual_rate, (SELECT round(100.0 * count(*) FILTER (WHERE any_linked) / count(*), 6) FROM d) AS doc_rate FROM m""")
def link_rates(spark, sf_dir):
    """A4: link rates by line, keyed line, usual group and document."""
    rows = linked_lines(spark, sf_dir)
    return L.link_rates(rows, "key", "doc", "mechanism", L.structural_groups(L.coverage(rows, "mechanism", F.col("linked")), "mechanism", 60.0))


@query(f"WITH l AS ({LINES}), g AS (SELECT key, count(*) AS n FROM l GROUP BY key) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(key) AS n_keys, max(n) AS most, round(CAST(sum(n) AS DOUBLE) / count(key), 6) AS rows_per_key FROM g")
def grain_diagnosis(spark, sf_dir):
    """A1: rows, keys and rows per key."""
    return L.grain(lines(spark, sf_dir), "key")


@query(f"""WITH l AS ({LINES}) SELECT coalesce(trim(key) <> '', false) AS has_key, count(*) AS n, count(*) FILTER (WHERE coalesce(mechanism NOT IN ('5-LOW', '3-MEDIUM'), false)) AS n_not_excluded,
  count(*) FILTER (WHERE coalesce(mechanism NOT IN ('5-LOW', '3-MEDIUM'), true)) AS n_nulls_counted, CAST(sum(CASE WHEN currency = 'CLP' THEN amount END) AS DOUBLE) AS native_total FROM l WHERE year BETWEEN 1996 AND 2000 GROUP BY 1""")
def key_and_exclusion_split(spark, sf_dir):
    """Keyed and unkeyed lines, an exclusion list under both NULL policies, native money."""
    rows = lines(spark, sf_dir).where(F.col("year").between(1996, 2000))
    keyed, rest = L.by_key_presence(rows, "key")
    m, out = F.col("mechanism"), ["5-LOW", "3-MEDIUM"]
    both = L.labelled_union({"true": keyed, "false": rest}, "has_key")
    return both.groupBy(F.col("has_key").cast("boolean").alias("has_key")).agg(
        F.count("*").alias("n"), F.count_if(L.not_excluded(m, out)).alias("n_not_excluded"), F.count_if(L.not_excluded(m, out, True)).alias("n_nulls_counted"),
        F.sum(M.native(F.col("amount"), F.col("currency"))).cast("double").alias("native_total"),
    )


@query(f"""WITH {_LINKED}, s AS (SELECT unnest([1995, 1997, 1999]) AS start)
SELECT start, currency, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(CASE WHEN linked THEN amount END) AS DOUBLE) AS linked_total,
  round(100.0 * CAST(sum(CASE WHEN linked THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS pct FROM j JOIN s ON year >= start GROUP BY 1, 2""")
def linked_money_by_start(spark, sf_dir):
    """A5: linked money by currency for several first years, in one pass."""
    return M.linked_money_by_start(linked_lines(spark, sf_dir), "year", [1995, 1997, 1999], "currency", "amount", F.col("linked"))


@query(f"""WITH {_LINKED} SELECT mechanism, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, round(CAST(sum(amount) AS DOUBLE) / count(amount), 4) AS mean_line,
  round(100.0 * CAST(sum(CASE WHEN linked THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS linked_pct FROM j GROUP BY mechanism""")
def linked_money_by_group(spark, sf_dir):
    """Linked money and the mean line by mechanism."""
    g = linked_lines(spark, sf_dir).groupBy("mechanism").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.count("amount").alias("c"), F.sum(F.when(F.col("linked"), F.col("amount"))).cast("double").alias("l"))
    return g.select("mechanism", "n", "total", F.round(F.col("total") / F.col("c"), 4).alias("mean_line"), F.round(100.0 * F.col("l") / F.col("total"), 6).alias("linked_pct"))


@query(f"""WITH {_LINKED}, y AS (SELECT linked, TRY_CAST(substr(nullif(upper(trim(key)), ''), -2) AS INTEGER) + 1900 AS ky FROM j),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE NOT linked AND coalesce(ky < 1950, false)) AS before_universe FROM y)
SELECT n, linked, before_universe, round(100.0 * linked / n, 6) AS rate, round(100.0 * linked / (n - before_universe), 6) AS adjusted_rate FROM s""")
def adjusted_link_rate(spark, sf_dir):
    """Unlinked keys that point before the loaded years leave the denominator."""
    from ..functions.clean import norm_key

    y = F.substring(norm_key(F.col("key")), -2, 2).try_cast("int") + 1900
    return L.adjusted_link_rate(linked_lines(spark, sf_dir), F.col("linked"), y, 1950)


@query(f"""WITH l AS ({LINES}), g AS (SELECT DISTINCT doc FROM l WHERE flag = 'R'), r AS (SELECT l.*, g.doc IS NOT NULL AS has_return FROM l LEFT JOIN g ON l.doc = g.doc)
SELECT has_return, year, count(*) AS n, count(DISTINCT doc) AS n_docs FROM r GROUP BY 1, 2""")
def flag_by_key(spark, sf_dir):
    """A flag of any line, brought back to all lines of its document."""
    rows = L.flagged_keys(lines(spark, sf_dir), "doc", F.col("flag") == "R", "has_return")
    return rows.groupBy("has_return", "year").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))


@query(f"""WITH a AS ({snapshot_sql(1)}), b AS ({snapshot_sql(2)}) SELECT CASE WHEN b.key IS NULL THEN 'only_old' WHEN a.key IS NULL THEN 'only_new' ELSE 'common' END AS side, count(*) AS n
FROM a FULL JOIN b USING (key) GROUP BY 1""")
def key_set_differences(spark, sf_dir):
    """Keys that only one snapshot has, and common ones."""
    return L.key_differences(snapshot(spark, sf_dir, 1), snapshot(spark, sf_dir, 2), "key").groupBy("side").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (WHERE a AND NOT b) AS only_first, count(*) FILTER (WHERE b AND NOT a) AS only_second, count(*) FILTER (WHERE a AND b) AS common, count(*) FILTER (WHERE a <> b) = 0 AS equal
FROM (SELECT coalesce(c_acctbal > 0, false) AS a, coalesce(c_acctbal >= 100, false) AS b FROM customer)""")
def selection_identity(spark, sf_dir):
    """Whether two ways of selecting give the same ids."""
    c = table(spark, sf_dir, "customer")
    return L.same_selection(c.where("c_acctbal > 0").select("c_custkey"), c.where("c_acctbal >= 100").select("c_custkey"), "c_custkey")


@query(f"""WITH a AS (SELECT year, month, count(*) AS n FROM ({snapshot_sql(1)}) WHERE NOT (year = 1996 AND month = 3) GROUP BY 1, 2), b AS (SELECT year, month, count(*) AS n FROM ({snapshot_sql(2)}) WHERE NOT (year = 1997 AND month = 5) GROUP BY 1, 2)
SELECT year, month, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, CASE WHEN a.n IS NULL THEN 'new_only' WHEN b.n IS NULL THEN 'missing' WHEN b.n < a.n THEN 'less' ELSE 'ok' END AS mark,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (year, month)""")
def month_counts_side_by_side(spark, sf_dir):
    """Monthly counts of two snapshots, with gaps marked."""
    a = snapshot(spark, sf_dir, 1).where(~((F.col("year") == 1996) & (F.col("month") == 3)))
    b = snapshot(spark, sf_dir, 2).where(~((F.col("year") == 1997) & (F.col("month") == 5)))
    return L.counts_side_by_side(a, b, ["year", "month"])


@query(f"""WITH s AS ({snapshot_sql(2)}), w AS (SELECT s_suppkey * 17 AS key FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey * 19 FROM supplier WHERE s_suppkey % 2 = 1)
SELECT w.key, coalesce(max(n), 0) AS n_rows, CAST(min(published) AS VARCHAR) AS published, min(supplier) AS supplier, max(n) IS NOT NULL AS present
FROM (SELECT DISTINCT key FROM w) w LEFT JOIN (SELECT key, count(*) AS n, min(published) AS published, min(supplier) AS supplier FROM s GROUP BY key) s USING (key) GROUP BY w.key""")
def watch_list(spark, sf_dir):
    """Whether listed keys are there, and what they hold."""
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 17).otherwise(F.col("s_suppkey") * 19).alias("key"))
    return L.watch(s, snapshot(spark, sf_dir, 2), "key", {"published": F.col("published").cast("string"), "supplier": F.col("supplier")})
