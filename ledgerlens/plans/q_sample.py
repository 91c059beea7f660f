"""Queries of sampling, weighting, association and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import assoc as A
from ..operators import ranks as R
from ..operators import sampling as S
from .registry import query
from .standin import LINES, lines, table

_BAND = "CASE WHEN amount <= 20000 THEN '1' WHEN amount <= 60000 THEN '2' ELSE '3' END"
_ROWS = f"""l AS (SELECT *, coalesce(mechanism, '?') AS m, {_BAND} AS band, substr(sha256(coalesce(code, '~') || '|' || coalesce(CAST(amount AS VARCHAR), '~') || '|' || coalesce(flag, '~')), 1, 16) AS cid FROM ({LINES}))"""


def rows(spark, sf_dir):
    """Lines with a stratum (mechanism, band) and the content id that orders them."""
    c = F.col
    return lines(spark, sf_dir).withColumn("m", F.coalesce("mechanism", F.lit("?"))).withColumn("band", C.bucket(c("amount"), [(20000, "1"), (60000, "2")], "3", "0")).withColumn("cid", C.content_id(c("code"), c("amount"), c("flag")))


_SAMPLE = f"""{_ROWS}, n AS (SELECT count(*) AS k FROM (SELECT DISTINCT m, band FROM l)), r AS (SELECT *, row_number() OVER (PARTITION BY m, band ORDER BY cid, doc, line, CAST(amount AS DOUBLE), entity) AS rk FROM l),
s AS (SELECT * FROM r, n WHERE rk <= greatest(1, CAST(floor(300.0 / k + 0.5) AS BIGINT)) ORDER BY cid, doc, line, amount, entity LIMIT 300)"""


def sample(spark, sf_dir):
    return S.bottom_k(rows(spark, sf_dir), ["m", "band"], "cid", 300, ["doc", "line", "amount", "entity"])


@query(f"WITH {_SAMPLE} SELECT cid, doc, line, m, band FROM s")
def bottom_k_sample(spark, sf_dir):
    """A stratified sample that any engine draws alike."""
    return sample(spark, sf_dir).select("cid", "doc", "line", "m", "band")


@query(f"WITH {_SAMPLE} SELECT cid, band, m FROM s")
def blind_sample(spark, sf_dir):
    """The sample without what could identify entities."""
    return S.blind(sample(spark, sf_dir), ["cid", "band", "m", "no_such_column"])


@query(f"WITH {_ROWS} SELECT m, band, count(*) AS n_lines, count(DISTINCT cid) AS n_contents, CAST(sum(amount) AS DOUBLE) AS total FROM l GROUP BY 1, 2")
def stratum_weights(spark, sf_dir):
    """Lines, contents and money of each stratum."""
    return S.stratum_sizes(rows(spark, sf_dir), ["m", "band"], "cid", "amount")


_PI = f"{_ROWS}, w AS (SELECT m, band, count(*) AS n_lines, count(DISTINCT cid) AS n_contents FROM l GROUP BY 1, 2), p AS (SELECT *, 1 - pow(1 - 0.001, n_contents) AS pi, 1 / (1 - pow(1 - 0.001, n_contents)) AS weight FROM w)"


def weights(spark, sf_dir):
    return S.inclusion(S.stratum_sizes(rows(spark, sf_dir), ["m", "band"], "cid", "amount"), "n_contents", 0.001)


@query(f"WITH {_PI} SELECT m, band, round(pi, 6) AS pi, round(weight, 6) AS weight FROM p")
def ht_weights(spark, sf_dir):
    """Inclusion probabilities and Horvitz-Thompson weights."""
    return weights(spark, sf_dir).select("m", "band", F.round("pi", 6).alias("pi"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_PI} SELECT round(sum(pi), 6) AS expected, round(sqrt(sum(pi * (1 - pi))), 6) AS sd, CAST(12 AS BIGINT) AS selected, round((12 - sum(pi)) / sqrt(sum(pi * (1 - pi))), 6) AS z FROM p")
def ht_calibration(spark, sf_dir):
    """Whether the design fits the number of strata selected."""
    return S.design_fit(weights(spark, sf_dir), 12)


@query(f"WITH {_PI} SELECT CASE WHEN pi <= 0.5 THEN 0 WHEN pi <= 0.9 THEN 1 ELSE 2 END AS band, count(*) AS n_strata, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM p GROUP BY 1")
def coverage_by_probability(spark, sf_dir):
    """How much of the universe lies in each band of probability."""
    return S.coverage_by_band(weights(spark, sf_dir), "n_lines", [0.5, 0.9])


_WEIGHTED = f"{_SAMPLE}, w AS (SELECT m, band, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT m, band, count(*) AS taken FROM s GROUP BY 1, 2), x AS (SELECT s.*, CAST(w.n AS DOUBLE) / c.taken AS weight FROM s JOIN w USING (m, band) JOIN c USING (m, band))"


def weighted(spark, sf_dir):
    """The sample with its strata's weights attached."""
    s, r = sample(spark, sf_dir), rows(spark, sf_dir)
    w = r.groupBy("m", "band").agg(F.count("*").alias("n")).join(s.groupBy("m", "band").agg(F.count("*").alias("k")), ["m", "band"])
    return s.join(F.broadcast(w), ["m", "band"]).withColumn("weight", F.col("n").cast("double") / F.col("k"))


@query(f"WITH {_WEIGHTED} SELECT count(*) AS n, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_effective, round(100 * (SELECT sum(weight) FROM (SELECT weight FROM x ORDER BY weight DESC LIMIT 5)) / sum(weight), 6) AS top_pct FROM x")
def kish_neff(spark, sf_dir):
    """The effective size of the weighted sample."""
    return S.kish(weighted(spark, sf_dir), "weight")


@query(f"WITH {_WEIGHTED} SELECT count(*) AS n, round(100 * sum(CASE WHEN flag = 'R' THEN weight ELSE 0 END) / sum(weight), 6) AS estimate FROM x")
def weighted_estimate(spark, sf_dir):
    """E5: a weighted share, the point of the bootstrap."""
    return S.weighted_estimate(weighted(spark, sf_dir), F.col("flag") == "R", "weight")


def _poisson() -> str:
    """Poisson(1) counts of a uniform u, by the cumulative probabilities of 0 to 7."""
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        steps.append(f"CAST(u >= {total!r}::DOUBLE AS INTEGER)")
        p /= k + 1
    return " + ".join(steps)


@query(f"""WITH {_WEIGHTED}, k AS (SELECT doc || '|' || line || '|' || cid AS k, weight, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS v FROM x),
d AS (SELECT b, weight, v, CAST(CAST('0x' || substr(md5(k || '|' || b || '|1'), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}::DOUBLE AS u FROM k, range(4000) r(b)),
e AS (SELECT 100 * sum(({_poisson()}) * weight * v) / nullif(sum(({_poisson()}) * weight), 0) AS e FROM d GROUP BY b)
SELECT (SELECT count(*) FROM k) AS n, (SELECT round(100 * sum(v * weight) / sum(weight), 6) FROM k) AS estimate, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high FROM e""")
def bootstrap_ci(spark, sf_dir):
    """E5: the share with its bootstrap interval."""
    return S.bootstrap(weighted(spark, sf_dir).withColumn("k", F.concat_ws("|", "doc", "line", "cid")), "k", F.col("flag") == "R", "weight")


@query(f"WITH {_ROWS}, v AS (SELECT m, amount, sum(quantity) AS w FROM l GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY m ORDER BY amount ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY m) AS t FROM v) SELECT m, CAST(min(amount) AS DOUBLE) AS weighted_median FROM c WHERE 2 * c >= t GROUP BY m")
def weighted_median(spark, sf_dir):
    """The weighted median of each mechanism."""
    return R.weighted_median(rows(spark, sf_dir), "amount", "quantity", ["m"]).withColumn("weighted_median", F.col("weighted_median").cast("double"))


@query(f"""WITH {_ROWS}, r AS (SELECT doc, line, m, (rank() OVER (PARTITION BY m ORDER BY amount) + (count(*) OVER (PARTITION BY m, amount) - 1) / 2.0) / count(*) OVER (PARTITION BY m) AS s FROM l)
SELECT m, count(*) AS n, count(*) FILTER (WHERE s <= 0.1) AS n_low, count(*) FILTER (WHERE s >= 0.9) AS n_high, round(avg(s), 6) AS mean_share FROM r GROUP BY m""")
def rank_share_extremes(spark, sf_dir):
    """Percentile rank inside each stratum, with ties on their mean."""
    r = R.average_rank_share(rows(spark, sf_dir), ["m"], "amount", "s")
    return r.groupBy("m").agg(F.count("*").alias("n"), F.count_if(F.col("s") <= 0.1).alias("n_low"), F.count_if(F.col("s") >= 0.9).alias("n_high"), F.round(F.avg("s"), 6).alias("mean_share"))


_ORDER = "year, m, doc, line, cid"
_SPREAD = f"""{_SAMPLE}, e AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY band) AS n FROM s),
f AS (SELECT *, CASE WHEN (rn - 1) % greatest(1, CAST(floor(n / 20.0) AS BIGINT)) <> 0 THEN 1 ELSE 0 END AS late FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY late, rn) AS pick FROM f)"""


@query(f"WITH {_SPREAD} SELECT band, year, m, doc, line FROM g WHERE pick <= 20")
def even_spread(spark, sf_dir):
    """Rows spread evenly along year and mechanism."""
    order = [F.col(c) for c in ("year", "m", "doc", "line", "cid")]
    return R.even_spread(sample(spark, sf_dir), ["band"], order, 20).select("band", "year", "m", "doc", "line")


_RULES = "CASE WHEN amount > 90000 THEN 'giant' WHEN code IS NULL THEN 'no_code' WHEN flag = 'R' THEN 'returned' END"


def _quota(spark, sf_dir):
    rules = [("giant", F.col("amount") > 90000), ("no_code", F.col("code").isNull()), ("returned", F.col("flag") == "R")]
    return S.quota_groups(rows(spark, sf_dir), rules, {"giant": 10, "no_code": 5, "returned": 20}, "cid", [F.col(c) for c in ("cid", "doc", "line", "amount", "entity")])


@query(f"""WITH {_ROWS}, g AS (SELECT *, {_RULES} AS "group", concat_ws('+', CASE WHEN amount > 90000 THEN 'giant' END, CASE WHEN code IS NULL THEN 'no_code' END, CASE WHEN flag = 'R' THEN 'returned' END) AS all_groups FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY cid, doc, line, amount, entity) AS rk FROM g WHERE "group" IS NOT NULL)
SELECT "group", all_groups, cid, doc, line FROM r WHERE rk <= CASE "group" WHEN 'giant' THEN 10 WHEN 'no_code' THEN 5 ELSE 20 END""")
def quota_selection(spark, sf_dir):
    """Cases by the first rule they meet, a quota of each."""
    return _quota(spark, sf_dir).select("group", "all_groups", "cid", "doc", "line")


@query(f"""WITH {_ROWS}, q AS (SELECT * FROM (VALUES ('giant', 10), ('no_code', 5), ('returned', 20)) t("group", quota)), g AS (SELECT {_RULES} AS "group", count(*) AS n FROM l GROUP BY 1)
SELECT q."group", quota, least(quota, coalesce(n, 0)) AS n, quota - least(quota, coalesce(n, 0)) AS missing FROM q LEFT JOIN g USING ("group")""")
def quota_shortfall(spark, sf_dir):
    """What each quota lacks."""
    return S.quota_shortfall(_quota(spark, sf_dir), {"giant": 10, "no_code": 5, "returned": 20})


@query("WITH u AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(doc_id || '|7'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents) SELECT doc_id FROM u WHERE u < CAST(400 AS DOUBLE) / (SELECT count(*) FROM documents)")
def row_budget(spark, sf_dir):
    """A reproducible sample of about a row budget."""
    return S.row_budget(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 400)


def cases(spark, sf_dir):
    """Documents with strata, a predictor, a coin for a placebo, and an outcome."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("c_mktsegment").alias("sector"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 150000).alias("large"), C.hash_parity(F.col("o_orderkey"), 3).alias("coin"), (F.col("o_orderstatus") == "F").alias("outcome"))


_CASES = """x AS (SELECT c_mktsegment AS sector, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice > 150000 AS large, ('0x' || substr(sha256(o_orderkey || '|3'), 1, 1))::INTEGER % 2 = 1 AS coin, o_orderstatus = 'F' AS y FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT sector, year, 'large' AS predictor, large AS p, y FROM x UNION ALL SELECT sector, year, 'placebo', coin, y FROM x),
t AS (SELECT sector, year, predictor, count(*) FILTER (WHERE p AND y) AS a, count(*) FILTER (WHERE p AND NOT y) AS b, count(*) FILTER (WHERE NOT p AND y) AS c, count(*) FILTER (WHERE NOT p AND NOT y) AS d FROM p GROUP BY 1, 2, 3)"""
_MH = f"""{_CASES}, n AS (SELECT *, (a + b + c + d)::DOUBLE AS n FROM t), u AS (SELECT *, n >= 30 AND a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0 AS ok FROM n),
g AS (SELECT predictor, count(*) FILTER (WHERE ok) AS used, count(*) FILTER (WHERE NOT ok) AS dropped, CAST(sum(n) FILTER (WHERE ok) AS BIGINT) AS n, (sum(a) FILTER (WHERE ok))::DOUBLE * sum(d) FILTER (WHERE ok) / (sum(b) FILTER (WHERE ok) * sum(c) FILTER (WHERE ok)) AS crude,
  sum(a * d / n) FILTER (WHERE ok) AS r, sum(b * c / n) FILTER (WHERE ok) AS s, sum((a + d) / n * a * d / n) FILTER (WHERE ok) AS pr, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) FILTER (WHERE ok) AS psqr, sum((b + c) / n * b * c / n) FILTER (WHERE ok) AS qs FROM u GROUP BY predictor),
h AS (SELECT predictor, used, dropped, n, round(crude, 4) AS crude_or, round(r / s, 4) AS pooled_or, round(exp(ln(r / s) - 1.959964 * sqrt(pr / (2 * r * r) + psqr / (2 * r * s) + qs / (2 * s * s))), 4) AS low, round(exp(ln(r / s) + 1.959964 * sqrt(pr / (2 * r * r) + psqr / (2 * r * s) + qs / (2 * s * s))), 4) AS high FROM g)"""


def cells(spark, sf_dir):
    return A.contingency(cases(spark, sf_dir), ["sector", "year"], {"large": F.col("large"), "placebo": F.col("coin") == 1}, F.col("outcome"))


@query(f"WITH {_CASES} SELECT * FROM t")
def stratified_contingency(spark, sf_dir):
    """2 x 2 counts by stratum, with the placebo in the same pass."""
    return cells(spark, sf_dir)


@query(f"WITH {_MH} SELECT * FROM h")
def mantel_haenszel(spark, sf_dir):
    """Crude and pooled odds ratios with intervals."""
    return A.mantel_haenszel(cells(spark, sf_dir))


@query(f"""WITH {_MH} SELECT predictor, CASE WHEN pooled_or IS NULL THEN 'undefined' WHEN pooled_or > 1 THEN 'positive' ELSE 'negative' END AS sign, coalesce(pooled_or >= 1.5, false) AS large, coalesce(low > 1 OR high < 1, false) AS excludes_one,
  (SELECT bool_and(abs(pooled_or - 1) <= 0.1) FROM h WHERE predictor = 'placebo') AS placebo_ok FROM h""")
def mh_placebo(spark, sf_dir):
    """The verdicts on sign, size, interval and placebo."""
    return A.mh_verdict(A.mantel_haenszel(cells(spark, sf_dir)), "placebo")


_RATERS = "r AS (SELECT doc_id, quality AS one, CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS two, CAST(doc_id % 5 AS INTEGER) AS i, CAST(CASE WHEN doc_id % 4 = 0 THEN (doc_id + 1) % 5 WHEN doc_id % 4 = 1 THEN (doc_id * 3) % 5 ELSE doc_id % 5 END AS INTEGER) AS j FROM labels)"


def raters(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("one"), F.when(k % 6 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("two"), (k % 5).cast("int").alias("i"), F.when(k % 4 == 0, (k + 1) % 5).when(k % 4 == 1, (k * 3) % 5).otherwise(k % 5).cast("int").alias("j"))


_KAPPA = f"""{_RATERS}, k AS (SELECT count(*) AS n, count(*) FILTER (WHERE one = 1 AND two = 1) AS "both", count(*) FILTER (WHERE one = 1 AND two <> 1) AS first_only, count(*) FILTER (WHERE one <> 1 AND two = 1) AS second_only, count(*) FILTER (WHERE one <> 1 AND two <> 1) AS neither FROM r)"""


@query(f"""WITH {_KAPPA}, p AS (SELECT *, ("both" + neither)::DOUBLE / n AS po, ("both" + first_only)::DOUBLE / n AS p1, ("both" + second_only)::DOUBLE / n AS p2 FROM k), e AS (SELECT *, p1 * p2 + (1 - p1) * (1 - p2) AS pe FROM p)
SELECT n, "both", first_only, second_only, neither, round(100 * po, 6) AS agreement_pct, round((po - pe) / (1 - pe), 6) AS kappa, round(sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))), 6) AS se FROM e""")
def two_rater_agreement(spark, sf_dir):
    """Cohen's kappa of two raters."""
    return A.cohen_kappa(raters(spark, sf_dir), "one", "two")


@query(f"""WITH {_KAPPA}, d AS (SELECT first_only + second_only AS n, least(first_only, second_only) AS m FROM k),
s AS (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) AS t FROM d, range(0, 100000) q(i) WHERE i <= m)
SELECT d.n AS discordant, round(CASE WHEN d.n = 0 THEN 1.0 ELSE least(1.0, 2 * t) END, 6) AS p FROM d, s""")
def mcnemar_exact(spark, sf_dir):
    """The exact McNemar test of two raters."""
    return A.mcnemar_exact(A.cohen_kappa(raters(spark, sf_dir), "one", "two")).select("discordant", "p")


@query(f"""WITH {_RATERS}, n AS (SELECT i, j, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2), l AS (SELECT i, sum(n) AS n FROM n GROUP BY 1), c AS (SELECT j, sum(n) AS n FROM n GROUP BY 1),
o AS (SELECT sum(n) AS t, sum(CASE WHEN i <> j THEN n ELSE 0 END) AS o1, sum(n * pow((i - j) / 4.0, 2)) AS o2 FROM n), e AS (SELECT sum(CASE WHEN i <> j THEN l.n * c.n ELSE 0 END) AS e1, sum(l.n * c.n * pow((i - j) / 4.0, 2)) AS e2 FROM l, c)
SELECT CAST(t AS BIGINT) AS n, round(1 - o1 * t / e1, 6) AS kappa, round(1 - o2 * t / e2, 6) AS quadratic_kappa FROM o, e""")
def ordinal_agreement(spark, sf_dir):
    """Kappa of ordinal raters, plain and quadratic."""
    return A.ordinal_kappa(raters(spark, sf_dir), "i", "j", 5)


@query(f"""WITH {_RATERS}, g AS (SELECT source AS g, count(*) AS n, count(*) FILTER (WHERE one <> two) AS k FROM r JOIN documents USING (doc_id) GROUP BY 1), h AS (SELECT CASE WHEN n >= 18 THEN g ELSE '(other)' END AS "group", CAST(sum(n) AS BIGINT) AS n, sum(k) AS k FROM g GROUP BY 1)
SELECT "group", n, round(100.0 * k / n, 6) AS discordant_pct FROM h""")
def discordance_by_group(spark, sf_dir):
    """Discordant pairs by source, small ones pooled."""
    j = raters(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return A.discordance_by_group(j, "source", "one", "two", 18)


@query(f"""WITH {_SAMPLE}, p AS (SELECT doc AS k, flag IS NOT NULL AND flag = 'R' AS known FROM s) SELECT count(*) AS n, count(*) FILTER (WHERE known) AS agree, count(*) FILTER (WHERE NOT known) AS disagree, round(100.0 * count(*) FILTER (WHERE known) / count(*), 6) AS agree_pct FROM p""")
def sample_concordance(spark, sf_dir):
    """Agreement in a sample, from a three-valued flag."""
    f = F.col("flag") == "R"
    g = sample(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(f).alias("agree"), F.count_if(~f).alias("disagree"))
    return g.withColumn("agree_pct", F.round(C.percent(F.col("agree"), F.col("agree") + F.col("disagree")), 6))
