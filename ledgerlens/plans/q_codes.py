"""Queries of code-set agreement: declared against realised codes of the same key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codesets as S
from .registry import query
from .standin import DECLARED, REALISED, declared, realised

SEED = 11

_PROFILES = f"""pa AS (SELECT key, count(*) AS n_a, list_sort(list_distinct(list(code) FILTER (WHERE regexp_full_match(code, '[0-9]{{8}}') AND NOT regexp_full_match(code, '0+')))) AS codes_a FROM ({DECLARED}) GROUP BY key),
pb AS (SELECT key, count(*) AS n_b, list_sort(list_distinct(list(code) FILTER (WHERE regexp_full_match(code, '[0-9]{{8}}') AND NOT regexp_full_match(code, '0+')))) AS codes_b FROM ({REALISED}) GROUP BY key),
p0 AS (SELECT pa.key, n_a, n_b, coalesce(codes_a, []) AS codes_a, coalesce(codes_b, []) AS codes_b FROM pa JOIN pb USING (key)),
p AS MATERIALIZED (SELECT *, CASE WHEN len(codes_a) = 0 AND len(codes_b) = 0 THEN 'E' WHEN len(codes_a) = 0 OR len(codes_b) = 0 THEN 'D' WHEN len(codes_a) = 1 AND len(codes_b) = 1 AND n_b = 1 THEN 'A'
  WHEN len(codes_a) = 1 AND len(codes_b) = 1 THEN 'B' ELSE 'C' END AS universe,
  CASE WHEN len(codes_a) = 0 THEN '00_none' WHEN len(codes_a) <= 1 THEN '01_single' WHEN len(codes_a) <= 2 THEN '02_two' WHEN len(codes_a) <= 5 THEN '03_3_to_5' WHEN len(codes_a) <= 10 THEN '04_6_to_10' WHEN len(codes_a) <= 20 THEN '05_11_to_20' ELSE '06_over_20' END AS bucket FROM p0)"""


def _agreement(source: str, by: str) -> str:
    return f"""(SELECT {by}, digits, count(*) AS n, round(100.0 * avg(CASE WHEN len(list_intersect(a, b)) > 0 THEN 1 ELSE 0 END), 6) AS overlap_pct,
  round(100.0 * avg(CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 1 ELSE 0 END), 6) AS subset_pct,
  round(100.0 * avg(CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 THEN 1 ELSE 0 END), 6) AS equal_pct,
  round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS jaccard
FROM (SELECT {by}, digits, list_distinct(list_transform(codes_a, lambda x: substr(x, 1, digits))) AS a, list_distinct(list_transform(codes_b, lambda x: substr(x, 1, digits))) AS b
      FROM {source}, (SELECT unnest([2, 4, 8]) AS digits) WHERE len(codes_a) > 0 AND len(codes_b) > 0) GROUP BY {by}, digits)"""


_NULL = f"""c AS (SELECT * FROM p WHERE universe = 'C'),
one AS (SELECT bucket, key, codes_a, row_number() OVER (PARTITION BY bucket ORDER BY sha256(key || '|{SEED}')) AS i FROM c),
two AS (SELECT bucket, key AS other, codes_b, row_number() OVER (PARTITION BY bucket ORDER BY sha256(key || '|{SEED + 7}')) AS i FROM c),
z AS (SELECT one.bucket, key, codes_a, codes_b, key = other AS self_pair FROM one JOIN two USING (bucket, i))"""


def pairs(spark, sf_dir):
    return S.paired(S.profile(declared(spark, sf_dir), "key", "code", side="a"), S.profile(realised(spark, sf_dir), "key", "code", side="b"), "key")


def informative(spark, sf_dir):
    return pairs(spark, sf_dir).where("universe = 'C'")


@query(f"WITH {_PROFILES} SELECT universe, bucket, count(*) AS n, CAST(sum(n_b) AS BIGINT) AS n_lines FROM p GROUP BY 1, 2")
def universe_typing(spark, sf_dir):
    """Keys by universe and size of the declared set."""
    return pairs(spark, sf_dir).groupBy("universe", "bucket").agg(F.count("*").alias("n"), F.sum("n_b").alias("n_lines"))


@query(f"WITH {_PROFILES} SELECT * FROM {_agreement('p', 'universe, bucket')}")
def codeset_agreement_real(spark, sf_dir):
    """Agreement at 2, 4 and 8 digits by universe and bucket."""
    return S.agreement(pairs(spark, sf_dir), ["universe", "bucket"])


@query(f"WITH {_PROFILES}, {_NULL} SELECT * FROM {_agreement('z', 'bucket')}")
def codeset_agreement_null(spark, sf_dir):
    """The same under a permutation inside each bucket."""
    return S.agreement(S.permuted(informative(spark, sf_dir), "key", ["bucket"], SEED), ["bucket"])


@query(f"WITH {_PROFILES}, {_NULL} SELECT bucket, count(*) AS n, count(*) FILTER (WHERE self_pair) AS n_self, round(100.0 * count(*) FILTER (WHERE self_pair) / count(*), 6) AS self_pct FROM z GROUP BY bucket")
def permutation_self_pairs(spark, sf_dir):
    """How often the permutation pairs a key with itself."""
    z = S.permuted(informative(spark, sf_dir), "key", ["bucket"], SEED)
    g = z.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("self_pair").alias("n_self"))
    return g.withColumn("self_pct", F.round(100.0 * F.col("n_self") / F.col("n"), 6))


@query(f"""WITH {_PROFILES}, {_NULL}, r AS (SELECT * FROM {_agreement('c', 'bucket')}), q AS (SELECT * FROM {_agreement('z', 'bucket')}),
g AS (SELECT r.digits, CAST(sum(r.n) AS BIGINT) AS n, round(sum(r.overlap_pct * r.n) / sum(r.n), 6) AS real_pct, round(sum(q.overlap_pct * q.n) / sum(q.n), 6) AS null_pct, bool_and(r.n = q.n) AS equal_n FROM r JOIN q USING (bucket, digits) GROUP BY 1)
SELECT *, round(real_pct - null_pct, 6) AS gap, round(real_pct - null_pct, 6) >= 20 AS above_null FROM g""")
def codeset_gap(spark, sf_dir):
    """Real minus null, with the check of equal n and the verdict."""
    c = informative(spark, sf_dir)
    return S.gap(S.agreement(c, ["bucket"]), S.agreement(S.permuted(c, "key", ["bucket"], SEED), ["bucket"]), ["bucket"], "overlap_pct", 20)


@query(f"""WITH {_PROFILES}, l AS (SELECT r.*, substr(code, 1, 4) AS c4, list_transform(codes_a, lambda x: substr(x, 1, 4)) AS s FROM ({REALISED}) r JOIN pa USING (key) WHERE len(codes_a) > 0 AND regexp_full_match(code, '[0-9]{{8}}') AND NOT regexp_full_match(code, '0+'))
SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(s, c4)) AS n_inside, round(100.0 * count(*) FILTER (WHERE list_contains(s, c4)) / count(*), 6) AS line_pct,
  round(100.0 * CAST(sum(CASE WHEN list_contains(s, c4) THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS money_pct FROM l""")
def weighted_coverage(spark, sf_dir):
    """The share of lines and money whose family the key declares."""
    return S.weighted_coverage(realised(spark, sf_dir), S.profile(declared(spark, sf_dir), "key", "code", side="a"), "key", "code", "amount")


def _depth(d: int) -> str:
    return f"WHEN len(list_intersect(list_transform(codes_a, lambda x: substr(x, 1, {d})), list_transform(codes_b, lambda x: substr(x, 1, {d})))) > 0 THEN {d}"


@query(f"""WITH {_PROFILES}, d AS (SELECT *, CASE {' '.join(map(_depth, (8, 6, 4, 2)))} ELSE 0 END AS depth FROM p WHERE len(codes_a) > 0 AND len(codes_b) > 0)
SELECT depth, count(*) AS n, round(100.0 * avg(CASE WHEN n_b = 1 THEN 1 ELSE 0 END), 6) AS single_line_pct FROM d GROUP BY depth""")
def match_depth_distribution(spark, sf_dir):
    """How deep the two sides agree, with an outcome rate."""
    p = pairs(spark, sf_dir).where((F.size("codes_a") > 0) & (F.size("codes_b") > 0))
    g = p.withColumn("depth", S.match_depth(F.col("codes_a"), F.col("codes_b"))).groupBy("depth")
    return g.agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("n_b") == 1).cast("int")), 6).alias("single_line_pct"))
