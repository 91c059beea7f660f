"""Queries of snapshot comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import link as L
from ..operators import snapshot as S
from .registry import query
from .standin import snapshot, snapshot_sql, table

_TOKENS = ", ".join(f"'{t}'" for t in C.NULL_TOKENS + C.NULL_KEYS)


def read(spark, sf_dir, version):
    """A snapshot with sentinel dates and null tokens turned into NULL first: a fill flag
    must not count them as data."""
    s = snapshot(spark, sf_dir, version)
    return s.withColumn("awarded", F.when(~C.is_sentinel(F.col("awarded")), F.col("awarded"))).withColumn("supplier", C.without_null_tokens(F.col("supplier"))).withColumn("has_bidders", F.when(F.col("bidders") > 0, F.col("bidders")))


def _read(version: int) -> str:
    return f"(SELECT * REPLACE (CASE WHEN year(awarded) >= 1980 THEN awarded END AS awarded, CASE WHEN upper(trim(supplier)) NOT IN ({_TOKENS}) THEN supplier END AS supplier), CASE WHEN bidders > 0 THEN bidders END AS has_bidders FROM ({snapshot_sql(version)}))"


_DIFF = f"""d AS (SELECT coalesce(a.year, b.year) AS year, CASE WHEN b.key IS NULL THEN 'only_old' WHEN a.key IS NULL THEN 'only_new' ELSE 'common' END AS side,
  a.awarded IS NULL AND b.awarded IS NOT NULL AS ga, a.awarded IS NOT NULL AND b.awarded IS NULL AS la, a.supplier IS NULL AND b.supplier IS NOT NULL AS gs, a.supplier IS NOT NULL AND b.supplier IS NULL AS ls,
  a.has_bidders IS NULL AND b.has_bidders IS NOT NULL AS gb, a.has_bidders IS NOT NULL AND b.has_bidders IS NULL AS lb FROM {_read(1)} a FULL JOIN {_read(2)} b USING (key)),
m AS (SELECT year, count(*) FILTER (WHERE side = 'only_old') AS only_old, count(*) FILTER (WHERE side = 'only_new') AS only_new, count(*) FILTER (WHERE side = 'common') AS common,
  count(*) FILTER (WHERE side = 'common' AND ga) AS gained_awarded, count(*) FILTER (WHERE side = 'common' AND la) AS lost_awarded, count(*) FILTER (WHERE side = 'common' AND gs) AS gained_supplier, count(*) FILTER (WHERE side = 'common' AND ls) AS lost_supplier,
  count(*) FILTER (WHERE side = 'common' AND gb) AS gained_bidders, count(*) FILTER (WHERE side = 'common' AND lb) AS lost_bidders FROM d GROUP BY year),
long AS (UNPIVOT m ON COLUMNS(* EXCLUDE year) INTO NAME metric VALUE value)"""


def metrics(spark, sf_dir):
    fields = {"awarded": "awarded", "supplier": "supplier", "bidders": "has_bidders"}
    a, b = read(spark, sf_dir, 1), read(spark, sf_dir, 2)
    d = S.diff(a, b, "key", fields)
    years = a.select("key", "year").unionByName(b.select("key", "year")).groupBy("key").agg(F.min("year").alias("year"))
    return S.diff_metrics(d.join(years, "key"), "year", list(fields))


@query(f"WITH {_DIFF} SELECT year, metric, value FROM long")
def snapshot_diff_long(spark, sf_dir):
    """What two snapshots gained and lost each year, in long form."""
    return metrics(spark, sf_dir)


@query(f"""WITH {_DIFF}, l AS (SELECT * FROM (VALUES ('only_old', 0), ('lost_awarded', 5000), ('lost_supplier', 100)) t(metric, most))
SELECT metric, CAST(sum(value) AS BIGINT) AS value, most, sum(value) <= most AS ok FROM long JOIN l USING (metric) GROUP BY metric, most""")
def snapshot_acceptance(spark, sf_dir):
    """Metrics against declared limits."""
    return S.accept(metrics(spark, sf_dir), {"only_old": 0, "lost_awarded": 5000, "lost_supplier": 100})


@query(f"""WITH d AS (SELECT l_suppkey % 20 AS part, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT part, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) AS most, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS factor FROM d GROUP BY part""")
def duplicate_factor(spark, sf_dir):
    """Rows over distinct natural keys, per partition."""
    return S.duplicate_factor(table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_suppkey") % 20), "part", ["l_orderkey", "l_linenumber"])


@query(f"SELECT strftime(published, '%Y-%m') AS month, count(*) AS n_keys, count(awarded) AS has_award, count(supplier) AS has_supplier, count(*) FILTER (WHERE bidders > 0) AS has_bidders, CAST(max(published) AS VARCHAR) AS last_published, CAST(max(awarded) AS VARCHAR) AS last_awarded, CAST(max(awarded) - max(published) AS INTEGER) AS maturity_days FROM {_read(2)} GROUP BY 1")
def download_calendar(spark, sf_dir):
    """Per publication month, how complete its keys are."""
    return S.download_calendar(read(spark, sf_dir, 2), "key", "published", "awarded", "supplier", "bidders")


@query(f"""WITH a AS (SELECT year, month, count(*) AS n FROM ({snapshot_sql(1)}) GROUP BY 1, 2), b AS (SELECT year, month, count(*) AS n FROM ({snapshot_sql(2)}) GROUP BY 1, 2),
j AS (SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS o, coalesce(b.n, 0) AS w FROM a FULL JOIN b USING (year, month))
SELECT year, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(w) AS BIGINT) AS n_new, count(*) FILTER (WHERE w < o) AS months_less, CASE WHEN count(*) FILTER (WHERE w < o) = 0 THEN 'superset' WHEN sum(w) >= sum(o) THEN 'mixed' ELSE 'less' END AS verdict FROM j GROUP BY year""")
def superset_by_count(spark, sf_dir):
    """Whether a new download has at least as many keys everywhere."""
    return S.superset_by_count(L.counts_side_by_side(snapshot(spark, sf_dir, 1), snapshot(spark, sf_dir, 2), ["year", "month"]), "year")


def _lags(rel: str, by: str, lag: str) -> str:
    """Order statistics at floor(n p) of a lag, per group."""
    return f"""(SELECT {by}, count(*) AS lag_n, list_sort(list({lag}))[CAST(least(floor(count(*) * 0.5), count(*) - 1) AS BIGINT) + 1] AS lag_median, list_sort(list({lag}))[CAST(least(floor(count(*) * 0.9), count(*) - 1) AS BIGINT) + 1] AS lag_p90, max({lag}) AS lag_max
FROM {rel} WHERE ({lag}) IS NOT NULL GROUP BY {by})"""


@query(f"""WITH s AS {_read(2)}, g AS (SELECT year, count(*) AS n, count(*) FILTER (WHERE awarded IS NULL) AS absent, count(*) FILTER (WHERE coalesce(awarded > DATE '1999-06-30', false)) AS censored, count(*) FILTER (WHERE coalesce(awarded <= DATE '1999-06-30', false)) AS seen FROM s GROUP BY year),
e AS (SELECT year, CAST(awarded - published AS INTEGER) AS lag FROM s WHERE awarded <= DATE '1999-06-30'), q AS {_lags('e', 'year', 'lag')}
SELECT g.*, lag_n, lag_median, lag_p90, lag_max, censored = 0 AS no_leverage FROM g LEFT JOIN q USING (year)""")
def censoring_by_year(spark, sf_dir):
    """Absent against censored events at a cut date, and the lag of those seen."""
    return S.censoring(read(spark, sf_dir, 2), "year", "published", "awarded", "1999-06-30")


@query(f"""WITH a AS (SELECT key, year, month FROM ({snapshot_sql(1)})), b AS (SELECT key, year, month FROM ({snapshot_sql(2)}))
SELECT year, month, count(a.key) AS n_old, count(b.key) AS n_new, count(*) FILTER (WHERE a.key IS NOT NULL AND b.key IS NOT NULL) AS common, count(*) FILTER (WHERE b.key IS NULL) AS lost, count(*) FILTER (WHERE a.key IS NULL) AS gained FROM a FULL JOIN b USING (key, year, month) GROUP BY 1, 2""")
def lost_keys_profile(spark, sf_dir):
    """Lost, gained and common keys by month."""
    return S.lost_keys(snapshot(spark, sf_dir, 1), snapshot(spark, sf_dir, 2), "key", ["year", "month"], "status")


@query(f"""WITH a AS ({snapshot_sql(1)}), b AS (SELECT key FROM ({snapshot_sql(2)})), g AS (SELECT CASE WHEN b.key IS NULL THEN 'lost' ELSE 'common' END AS side, status, count(*) AS n FROM a LEFT JOIN b ON a.key = b.key GROUP BY 1, 2)
SELECT side, status, n, round(100.0 * n / sum(n) OVER (PARTITION BY side), 6) AS pct FROM g""")
def lost_key_states(spark, sf_dir):
    """The state mix of lost against common keys."""
    return S.lost_states(snapshot(spark, sf_dir, 1), snapshot(spark, sf_dir, 2), "key", "status")


@query(f"""WITH s AS {_read(2)}, l AS (SELECT 'awarded' AS "column", awarded AS d, published AS b FROM s UNION ALL SELECT 'estimated', estimated, published FROM s UNION ALL SELECT 'published', published, published FROM s),
g AS (SELECT "column", count(*) AS n, count(d) AS filled, CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date, count(*) FILTER (WHERE d > DATE '2001-01-01') AS in_future, count(*) FILTER (WHERE d < b) AS negative, round(100.0 * count(d) / count(*), 6) AS filled_pct FROM l GROUP BY 1),
e AS (SELECT "column", CAST(d - b AS INTEGER) AS lag FROM l), q AS {_lags('e', '"column"', 'lag')}
SELECT g.*, lag_n, lag_median, lag_p90, lag_max FROM g LEFT JOIN q USING ("column")""")
def date_column_profile(spark, sf_dir):
    """Filled, first, last, future and lag of every date column."""
    c = {n: F.col(n) for n in ("awarded", "estimated", "published")}
    return S.date_profile(read(spark, sf_dir, 2), c, F.col("published"), "2001-01-01")


@query(f"""WITH s AS {_read(1)}, g AS (SELECT year, month, count(*) AS n_keys, count(awarded) AS with_date, count(*) FILTER (WHERE awarded > DATE '2001-06-01') AS in_future, round(100.0 * count(awarded) / count(*), 6) AS with_date_pct, CAST(floor((2001 - year) * 12 + (6 - month)) AS INTEGER) AS age_months FROM s GROUP BY 1, 2),
e AS (SELECT year, month, CAST(awarded - published AS INTEGER) AS lag FROM s), q AS {_lags('e', 'year, month', 'lag')}
SELECT g.*, lag_n, lag_median, lag_p90, lag_max FROM g LEFT JOIN q USING (year, month)""")
def maturation_curve(spark, sf_dir):
    """How a monthly file fills up with age."""
    return S.maturation(read(spark, sf_dir, 1), "key", ["year", "month"], "published", "awarded", "2001-06-01")


@query(f"""WITH s AS {_read(2)}, k AS (SELECT awarded = estimated AS same, status = 'F' AS c FROM s WHERE awarded IS NOT NULL AND estimated IS NOT NULL), g AS (SELECT count(*) FILTER (WHERE c) AS n_control, count(*) FILTER (WHERE NOT c) AS n_other, 100.0 * avg(CASE WHEN c THEN CAST(same AS INTEGER) END) AS x, 100.0 * avg(CASE WHEN NOT c THEN CAST(same AS INTEGER) END) AS y FROM k)
SELECT n_control, n_other, round(x, 6) AS control_pct, round(y, 6) AS other_pct, round(y - x, 6) AS difference, CASE WHEN y - x >= 30 THEN 'imputed' WHEN y - x >= 10 THEN 'suspect' ELSE 'no_sign' END AS verdict FROM g""")
def imputation_test(spark, sf_dir):
    """Whether missing dates were filled with the estimate."""
    return S.imputation_test(read(spark, sf_dir, 2), "key", "awarded", "estimated", F.col("status") == "F")


@query("""WITH r AS (SELECT l_suppkey % 5 AS part, l_orderkey AS doc, l_linenumber, CASE WHEN l_orderkey % 31 <> 0 THEN l_partkey END AS code, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem),
d AS (SELECT *, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT part, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT doc) AS n_docs, CAST(sum(n - 1) AS BIGINT) AS repeated_rows, CAST(sum(CASE WHEN code IS NULL THEN n ELSE 0 END) AS BIGINT) AS without_code, CAST(sum(n * q) AS DOUBLE) AS sum_q FROM d GROUP BY part)
SELECT part, n_rows, n_docs, repeated_rows, without_code, sum_q, round(CAST(n_rows AS DOUBLE) / n_docs, 6) AS lines_per_doc, CASE WHEN part < 4 THEN 12000 END AS frozen_rows,
  CASE WHEN part < 4 THEN round(100.0 * (n_rows - 12000) / 12000, 6) END AS delta_pct, CASE WHEN part >= 4 THEN 'no_reference' WHEN abs(100.0 * (n_rows - 12000) / 12000) <= 2 THEN 'same' WHEN abs(100.0 * (n_rows - 12000) / 12000) <= 15 THEN 'moved' ELSE 'different' END AS band FROM g""")
def redownload_profile(spark, sf_dir):
    """Rows, repeats and sums of a new download against frozen counts."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("part"), F.col("l_orderkey").alias("doc"), "l_linenumber", F.when(F.col("l_orderkey") % 31 != 0, F.col("l_partkey")).alias("code"), F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    frozen = spark.range(4).select(F.col("id").alias("part"), F.lit(12000).alias("frozen_rows"))
    return S.redownload_profile(rows, "part", "doc", ["q"], "code", frozen)


@query(f"""WITH u AS (SELECT key % 5000 AS k, published, supplier, status = 'F' AS closed FROM {_read(1)}) SELECT k, count(*) AS n_rows, CAST(min(published) AS VARCHAR) AS published, min(supplier) AS supplier, bool_or(closed) AS closed FROM u GROUP BY k""")
def record_consolidation(spark, sf_dir):
    """One row a key, with its first value of each field and its flags."""
    rows = read(spark, sf_dir, 1).select((F.col("key") % 5000).alias("k"), F.col("published").cast("string").alias("published"), "supplier", (F.col("status") == "F").alias("closed"))
    return S.consolidate(rows, "k", ["published", "supplier"], ["closed"])


@query(f"SELECT year, month, count(*) AS n, count(awarded) AS n_awarded FROM ({snapshot_sql(2)}) WHERE year * 12 + month BETWEEN 1996 * 12 + 11 AND 1998 * 12 + 2 GROUP BY 1, 2")
def snapshot_period(spark, sf_dir):
    """a snapshot's rows of a run of months, both ends included."""
    rows = snapshot(spark, sf_dir, 2).where(S.in_period(F.col("year"), F.col("month"), (1996, 11), (1998, 2)))
    return rows.groupBy("year", "month").agg(F.count("*").alias("n"), F.count("awarded").alias("n_awarded"))
