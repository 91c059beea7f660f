"""Queries of the cleaning functions, over texts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from .registry import query
from .standin import TEXTS, table, texts

NBSP = " "
_TOKENS = ", ".join(f"'{t}'" for t in C.NULL_TOKENS)
_KEYS = ", ".join(f"'{t}'" for t in C.NULL_KEYS)


def _numbers(spark, sf_dir):
    """Prices as they are typed: nine ways, by the order's key."""
    p, k = F.col("l_extendedprice"), F.col("l_orderkey") % 9
    cents = F.round(p * 100).cast("long")
    whole, part = (cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    high, low = (whole / 1000).cast("long"), F.lpad((whole % 1000).cast("string"), 3, "0")
    text = (
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, whole.cast("string")).when(k == 2, F.concat(whole.cast("string"), F.lit(","), part))
        .when(k == 3, F.concat((high % 1000).cast("string"), F.lit("."), low, F.lit(","), part)).when(k == 4, F.concat((high % 1000).cast("string"), F.lit("."), low))
        .when(k == 5, F.concat(F.lit("1."), low, F.lit("."), low, F.lit(","), part)).when(k == 6, F.lit("1,5E3")).when(k == 7, F.concat(F.lit(f"$ 1{NBSP}"), low)).otherwise(F.lit("S/I"))
    )
    return table(spark, sf_dir, "lineitem").select(text.alias("t"))


_NUMBERS = f"""src AS (SELECT l_orderkey % 9 AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
parts AS (SELECT k, cents // 100 AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS part, cents // 100 // 1000 AS high, lpad(CAST(cents // 100 % 1000 AS VARCHAR), 3, '0') AS low FROM src),
texts AS (SELECT CASE k WHEN 0 THEN NULL WHEN 1 THEN CAST(whole AS VARCHAR) WHEN 2 THEN whole || ',' || part WHEN 3 THEN (high % 1000) || '.' || low || ',' || part
  WHEN 4 THEN (high % 1000) || '.' || low WHEN 5 THEN '1.' || low || '.' || low || ',' || part WHEN 6 THEN '1,5E3' WHEN 7 THEN '$ 1' || chr(160) || low ELSE 'S/I' END AS t FROM parts),
bared AS (SELECT t, regexp_replace(t, '[\\s$' || chr(160) || ']', '', 'g') AS b FROM texts),
classed AS (SELECT *, CASE WHEN t IS NULL OR b = '' THEN 'empty' WHEN regexp_full_match(b, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(b, '-?[0-9]+,[0-9]+') THEN 'comma_decimal'
  WHEN regexp_full_match(b, '-?[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+') THEN 'thousands_comma' WHEN regexp_full_match(b, '-?[0-9]{{1,3}}(\\.[0-9]{{3}})+') THEN 'dot_thousands_or_decimal'
  WHEN regexp_full_match(b, '-?[0-9]+\\.[0-9]+') THEN 'dot_decimal' WHEN regexp_full_match(b, '-?[0-9]+([.,][0-9]+)?[eE][+-]?[0-9]+') THEN 'scientific' ELSE 'other' END AS cls FROM bared),
read AS (SELECT *,
  TRY_CAST(CASE WHEN cls = 'integer' THEN b WHEN cls = 'comma_decimal' THEN replace(b, ',', '.') WHEN cls = 'thousands_comma' THEN replace(replace(b, '.', ''), ',', '.') END AS DECIMAL(18,4)) AS strict,
  CAST(TRY_CAST(CASE WHEN upper(b) NOT IN ({_TOKENS}) THEN CASE WHEN contains(b, ',') THEN replace(replace(b, '.', ''), ',', '.') ELSE b END END AS DOUBLE) AS DECIMAL(18,4)) AS tolerant FROM classed)"""


@query(f"""WITH {_NUMBERS} SELECT cls, count(*) AS n, count(strict) AS n_strict, count(tolerant) AS n_tolerant,
  CAST(sum(CASE WHEN upper(trim(t)) NOT IN ({_TOKENS}) AND strict IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS strict_failed,
  CAST(sum(CASE WHEN upper(trim(t)) NOT IN ({_TOKENS}) AND tolerant IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tolerant_failed,
  CAST(sum(strict) AS DOUBLE) AS strict_sum, CAST(sum(tolerant) AS DOUBLE) AS tolerant_sum FROM read GROUP BY cls""")
def locale_number_audit(spark, sf_dir):
    """Classes of typed numbers, both readings, and what each could not read."""
    t = F.col("t")
    rows = _numbers(spark, sf_dir).select(t, C.number_class(t).alias("cls"), C.strict_number(t).alias("strict"), C.tolerant_number(t).alias("tolerant"))
    return rows.groupBy("cls").agg(
        F.count("*").alias("n"), F.count("strict").alias("n_strict"), F.count("tolerant").alias("n_tolerant"),
        F.sum(C.parse_failed(t, F.col("strict"))).alias("strict_failed"), F.sum(C.parse_failed(t, F.col("tolerant"))).alias("tolerant_failed"),
        F.sum("strict").cast("double").alias("strict_sum"), F.sum("tolerant").cast("double").alias("tolerant_sum"),
    )


@query(f"""WITH {_NUMBERS} SELECT count(*) AS n, CAST(sum(CASE WHEN upper(trim(t)) NOT IN ({_TOKENS}) AND strict IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  round(100.0 * sum(CASE WHEN upper(trim(t)) NOT IN ({_TOKENS}) AND strict IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS failed_pct,
  100.0 * sum(CASE WHEN upper(trim(t)) NOT IN ({_TOKENS}) AND strict IS NULL THEN 1 ELSE 0 END) / count(*) <= 0.1 AS accepted FROM read""")
def strict_cast_gate(spark, sf_dir):
    """Whether a column reads strictly with at most 0.1 per cent left over."""
    t = F.col("t")
    g = _numbers(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(C.parse_failed(t, C.strict_number(t))).alias("failed"))
    p = C.percent(F.col("failed"), F.col("n"))
    return g.select("n", "failed", F.round(p, 6).alias("failed_pct"), (p <= 0.1).alias("accepted"))


def _dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(d, "dd-MM-yyyy"))
        .when(k == 3, F.date_format(d, "dd/MM/yyyy")).when(k == 4, F.lit("0")).when(k == 5, F.lit("1900-01-01")).when(k == 6, F.lit("2036-01-01"))
    )
    return table(spark, sf_dir, "orders").select(k.cast("int").alias("kind"), text.alias("t"), F.year(d).alias("y"))


@query("""WITH src AS (SELECT CAST(o_orderkey % 8 AS INTEGER) AS kind, o_orderdate AS d FROM orders),
texts AS (SELECT kind, CASE kind WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(d, '%d-%m-%Y')
  WHEN 3 THEN strftime(d, '%d/%m/%Y') WHEN 4 THEN '0' WHEN 5 THEN '1900-01-01' WHEN 6 THEN '2036-01-01' END AS t FROM src),
read AS (SELECT *, CAST(coalesce(try_strptime(substr(t, 1, 10), '%Y-%m-%d'), try_strptime(substr(t, 1, 10), '%d-%m-%Y'), try_strptime(substr(t, 1, 10), '%d/%m/%Y')) AS DATE) AS d FROM texts),
kept AS (SELECT *, CASE WHEN year(d) >= 1980 THEN d END AS r FROM read)
SELECT kind, count(*) AS n, count(d) AS parsed, CAST(sum(CASE WHEN d IS NOT NULL AND r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS sentinels,
  CAST(sum(CASE WHEN r > DATE '2030-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS in_future, CAST(min(r) AS VARCHAR) AS first_date, CAST(max(r) AS VARCHAR) AS last_date FROM kept GROUP BY kind""")
def safe_date_audit(spark, sf_dir):
    """Dates in four formats, with the sentinels counted and taken out."""
    t = F.col("t")
    rows = _dates(spark, sf_dir).select("kind", C.any_date(t).alias("d"), C.real_date(t).alias("r"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("d").alias("parsed"), F.count_if(F.col("d").isNotNull() & F.col("r").isNull()).alias("sentinels"),
        F.count_if(F.col("r") > F.lit("2030-01-01").cast("date")).alias("in_future"), F.min("r").cast("string").alias("first_date"), F.max("r").cast("string").alias("last_date"),
    )


def _codes(spark, sf_dir):
    x, k = F.col("p_partkey"), F.col("p_partkey") % 10
    base = F.lpad(((x * 48611) % 100000000).cast("string"), 8, "0")
    text = (
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(" ")).when(k == 2, F.concat(base, F.lit(".0"))).when(k == 3, F.lit("0")).when(k == 4, F.lit("00000000"))
        .when(k == 5, F.lit("ZGEN0001")).when(k == 6, F.substring(base, 2, 7)).when(k == 7, F.concat(F.lit("9"), base)).otherwise(base)
    )
    return table(spark, sf_dir, "part").select(text.alias("code"))


_CODES = """src AS (SELECT p_partkey % 10 AS k, lpad(CAST(p_partkey * 48611 % 100000000 AS VARCHAR), 8, '0') AS base FROM part),
codes AS (SELECT CASE k WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN base || '.0' WHEN 3 THEN '0' WHEN 4 THEN '00000000' WHEN 5 THEN 'ZGEN0001' WHEN 6 THEN substr(base, 2, 7) WHEN 7 THEN '9' || base ELSE base END AS code FROM src)"""


@query(f"""WITH {_CODES}, t AS (SELECT code, regexp_replace(trim(code), '\\.0+$', '') AS t FROM codes),
c AS (SELECT t, CASE WHEN code IS NULL OR t = '' THEN 'absent' WHEN regexp_full_match(t, '0+') THEN 'zero' WHEN regexp_full_match(t, '[0-9]{{8}}') THEN 'valid' WHEN regexp_full_match(t, '[0-9]+') THEN 'other_format' ELSE 'not_numeric' END AS cls FROM t)
SELECT cls, count(*) AS n, count(DISTINCT CASE WHEN cls = 'valid' THEN t END) AS n_codes FROM c GROUP BY cls""")
def code_class_audit(spark, sf_dir):
    """Validity classes of hierarchical codes."""
    c = F.col("code")
    rows = _codes(spark, sf_dir).select(C.code_class(c).alias("cls"), C.valid_code(c).alias("v"))
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_codes"))


@query(f"""WITH {_CODES}, c AS (SELECT CASE WHEN code IS NULL OR trim(code) = '' THEN 'empty' WHEN regexp_full_match(trim(code), '0+') THEN 'zeros' WHEN regexp_full_match(trim(code), '[0-9]{{8}}') THEN 'ok'
  WHEN regexp_full_match(trim(code), '[0-9]{{1,7}}') THEN 'short' WHEN regexp_full_match(trim(code), '[0-9]+') THEN 'long' WHEN regexp_full_match(trim(code), '[0-9]+\\.[0-9]+') THEN 'decimal' ELSE 'not_numeric' END AS shape FROM codes)
SELECT shape, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS pct FROM c GROUP BY shape""")
def malformed_code_shapes(spark, sf_dir):
    """What is wrong with the codes as written, with shares."""
    from pyspark.sql import Window

    n = _codes(spark, sf_dir).groupBy(C.code_shape(F.col("code")).alias("shape")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(C.percent(F.col("n"), F.sum("n").over(Window.partitionBy())), 6))


@query("""WITH keys AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN (o_custkey || '-' || o_orderkey || '-LR' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')) WHEN 1 THEN (' ' || o_custkey || '-' || o_orderkey || '-le1' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0'))
  WHEN 2 THEN 'sinGuion' WHEN 3 THEN ' ' WHEN 4 THEN NULL ELSE (o_custkey || '-X') END AS key FROM orders),
p AS (SELECT CASE WHEN contains(trim(key), '-') THEN split_part(trim(key), '-', 1) END AS unit, upper(split_part(trim(key), '-', -1)) AS tail FROM keys),
q AS (SELECT unit, nullif(regexp_extract(tail, '^([A-Z]+)', 1), '') AS kind, TRY_CAST(nullif(regexp_extract(tail, '^[A-Z]+[0-9]?([0-9]{2})$', 1), '') AS INTEGER) + 2000 AS y FROM p)
SELECT kind, y AS key_year, count(*) AS n, count(DISTINCT unit) AS n_units FROM q GROUP BY kind, y""")
def key_parse_audit(spark, sf_dir):
    """C11: unit, kind and year inside structured keys."""
    k, y = F.col("o_orderkey") % 6, F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    c, o = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    key = (
        F.when(k == 0, F.concat(c, F.lit("-"), o, F.lit("-LR"), y)).when(k == 1, F.concat(F.lit(" "), c, F.lit("-"), o, F.lit("-le1"), y))
        .when(k == 2, "sinGuion").when(k == 3, " ").when(k == 4, F.lit(None).cast("string")).otherwise(F.concat(c, F.lit("-X")))
    )
    rows = table(spark, sf_dir, "orders").select(key.alias("key"))
    rows = rows.select(C.key_unit(F.col("key")).alias("unit"), C.key_kind(F.col("key")).alias("kind"), C.key_year(F.col("key")).alias("key_year"))
    return rows.groupBy("kind", "key_year").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("n_units"))


_NORM = "nullif(trim(regexp_replace(regexp_replace(translate(lower(regexp_replace(text, '_x[0-9A-Fa-f]{4}_', ' ', 'g')), '%s', '%s'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '')" % C.ACCENTS


@query(f"WITH t AS ({TEXTS}), n AS (SELECT id, {_NORM} AS v FROM t) SELECT id, CAST(length(v) AS INTEGER) AS n_chars, md5(v) AS digest, coalesce(trim(regexp_replace(regexp_replace(v, 'segun bases|insumo', ' ', 'g'), ' +', ' ', 'g')) = v, false) AS no_boilerplate FROM n")
def text_normalisation(spark, sf_dir):
    """Every text folded to plain lower case, and whether boilerplate was in it."""
    v = C.norm_text(F.col("text"))
    rows = texts(spark, sf_dir).select("id", v.alias("v"))
    clean = C.without_boilerplate(F.col("v"), ["segun bases", "insumo"])
    return rows.select("id", F.length("v").alias("n_chars"), F.md5(F.col("v").cast("binary")).alias("digest"), F.coalesce(clean == F.col("v"), F.lit(False)).alias("no_boilerplate"))


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' 76.' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '-k ' WHEN 1 THEN '76 ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '5' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE '7' END AS t FROM customer),
u AS (SELECT c_custkey, upper(regexp_replace(trim(t), '[.\\s]', '', 'g')) AS t FROM r)
SELECT c_custkey, CASE WHEN t = '' THEN NULL WHEN contains(t, '-') OR length(t) < 2 THEN t ELSE regexp_replace(t, '^(.*)(.)$', '\\1-\\2') END AS tax_id FROM u""")
def tax_id_normalisation(spark, sf_dir):
    """Tax ids with one spelling."""
    c, k = F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.col("c_custkey") % 5
    t = F.when(k == 0, F.concat(F.lit(" 76."), c, F.lit("-k "))).when(k == 1, F.concat(F.lit("76 "), c, F.lit("5"))).when(k == 2, "").when(k == 3, F.lit(None).cast("string")).otherwise("7")
    return table(spark, sf_dir, "customer").select("c_custkey", C.tax_id(t).alias("tax_id"))


@query(f"""WITH r AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN ' s/i ' WHEN o_orderkey % 4 = 1 THEN ' ' ELSE o_orderpriority END AS t FROM orders),
c AS (SELECT CASE WHEN upper(trim(t)) NOT IN ({_TOKENS}, {_KEYS}) THEN trim(t) END AS useful, t,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FAST' ELSE o_orderpriority END AS recoded,
  CASE WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 200000 THEN 'middle' ELSE 'high' END AS band,
  CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'urgent' WHEN contains(lower(o_orderpriority), 'low') THEN 'slow' ELSE 'other' END AS status,
  substr(sha256(coalesce(CAST(o_custkey AS VARCHAR), '~') || '|' || coalesce(o_orderstatus, '~')), 1, 16) AS cid,
  ('0x' || substr(sha256(o_orderkey || '|' || 0), 1, 1))::INTEGER % 2 AS coin FROM r)
SELECT recoded, band, status, coin, count(*) AS n, count(useful) AS n_useful, CAST(sum(CASE WHEN t IS NOT NULL AND trim(t) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_filled, count(DISTINCT cid) AS n_ids, min(cid) AS first_id FROM c GROUP BY 1, 2, 3, 4""")
def value_mapping_profile(spark, sf_dir):
    """Null tokens, recodes, bands, status classes, content ids, coins."""
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, " s/i ").when(k % 4 == 1, " ").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(
        C.without_null_tokens(t).alias("useful"), C.filled(t).alias("filled"), C.recode(F.col("o_orderpriority"), {"1-URGENT": "FAST", "2-HIGH": "FAST"}).alias("recoded"),
        C.bucket(F.col("o_totalprice"), [(50000, "low"), (200000, "middle")], "high", "missing").alias("band"), C.status_class(F.col("o_orderpriority"), [("urgent", "urgent"), ("low", "slow")]).alias("status"),
        C.content_id(F.col("o_custkey"), F.col("o_orderstatus")).alias("cid"), C.hash_parity(k, 0).alias("coin"),
    )
    return rows.groupBy("recoded", "band", "status", "coin").agg(F.count("*").alias("n"), F.count("useful").alias("n_useful"), F.count_if("filled").alias("n_filled"), F.count_distinct("cid").alias("n_ids"), F.min("cid").alias("first_id"))


@query("""WITH cpi AS (SELECT y, m, 100.0 + (y - 1995) * 4 + m / 4.0 AS idx FROM range(1995, 2001) a(y), range(1, 13) b(m)),
base AS (SELECT max(idx) AS top FROM cpi)
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(idx) AS n_deflated, round(sum(coalesce(o_totalprice * top / idx, o_totalprice)), 2) AS real_total
FROM orders LEFT JOIN cpi ON y = year(o_orderdate) AND m = month(o_orderdate), base GROUP BY 1""")
def deflated_totals(spark, sf_dir):
    """Amounts in money of the last month of a price index; years without one stay nominal."""
    from ..operators.money import deflate

    n = spark.range(72).select((F.lit(1995) + F.floor(F.col("id") / 12)).cast("int").alias("y"), (F.col("id") % 12 + 1).cast("int").alias("m"))
    cpi = n.withColumn("idx", F.lit(100.0) + (F.col("y") - 1995) * 4 + F.col("m") / 4.0)
    rows = deflate(table(spark, sf_dir, "orders"), cpi, "o_orderdate", "o_totalprice")
    return rows.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count("price_index").alias("n_deflated"), F.round(F.sum("real_amount"), 2).alias("real_total"))


@query("""WITH r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'si' WHEN 1 THEN 'false' WHEN 2 THEN '-' ELSE 'x' END AS b, CASE o_orderkey % 3 WHEN 0 THEN '12,50' WHEN 1 THEN 'abc' ELSE '7' END AS n, CASE o_orderkey % 2 WHEN 0 THEN '01/05/2024' ELSE '2024-13-01' END AS d FROM orders)
SELECT count(*) AS n, CAST(sum(CASE WHEN b IN ('si') THEN 1 ELSE 0 END) AS BIGINT) AS bool_true, CAST(sum(CASE WHEN b = 'x' THEN 1 ELSE 0 END) AS BIGINT) AS bool_failed,
  CAST(sum(CASE WHEN n = '12,50' THEN 12.5 WHEN n = '7' THEN 7 END) AS DOUBLE) AS double_sum, CAST(sum(CASE WHEN n = 'abc' THEN 1 ELSE 0 END) AS BIGINT) AS double_failed, CAST(sum(CASE WHEN d = '2024-13-01' THEN 1 ELSE 0 END) AS BIGINT) AS date_failed FROM r""")
def typed_coercion(spark, sf_dir):
    """Texts to target types, with what failed."""
    k = F.col("o_orderkey")
    b, n, d = F.when(k % 4 == 0, "si").when(k % 4 == 1, "false").when(k % 4 == 2, "-").otherwise("x"), F.when(k % 3 == 0, "12,50").when(k % 3 == 1, "abc").otherwise("7"), F.when(k % 2 == 0, "01/05/2024").otherwise("2024-13-01")
    rows = table(spark, sf_dir, "orders").select(b.alias("b"), n.alias("n"), d.alias("d"))
    fail = lambda c, kind: F.sum(C.parse_failed(F.col(c), C.coerced(F.col(c), kind)))
    return rows.agg(F.count("*").alias("n"), F.count_if(C.coerced(F.col("b"), "bool")).alias("bool_true"), fail("b", "bool").alias("bool_failed"), F.sum(C.coerced(F.col("n"), "double")).alias("double_sum"), fail("n", "double").alias("double_failed"), fail("d", "date").alias("date_failed"))


@query("SELECT CAST(o_custkey % 50 AS INTEGER) AS k, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_whole, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') / nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0), 6) AS pct FROM orders GROUP BY 1")
def null_safe_percentage(spark, sf_dir):
    """Shares of groups, NULL where a group has nothing to take a share of."""
    whole = F.col("o_orderstatus") == "P"
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).cast("int").alias("k")).agg(F.count_if(whole).alias("n_whole"), F.count_if(whole & (F.col("o_orderpriority") == "1-URGENT")).alias("n"))
    return g.select("k", "n_whole", F.round(C.percent(F.col("n"), F.col("n_whole")), 6).alias("pct"))
