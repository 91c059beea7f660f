"""Queries of cascades and money."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import cascade as K
from ..operators import money as M
from ..operators import ranks as R
from .q_link import _LINKED, linked_lines
from .registry import query
from .standin import LINES, lines, table

_VALID = "(regexp_full_match(code, '[0-9]{8}') AND NOT regexp_full_match(code, '0+'))"
_ERROR = "coalesce(price = quantity AND price > 1000, false)"
_RUNGS = [("all", "true"), ("in_years", "year BETWEEN 1996 AND 2000"), ("keyed", "trim(key) <> ''"), ("linked", "linked"), ("native", "currency = 'CLP'"), ("coded", _VALID), ("returned", "flag = 'R'")]


def rungs():
    c = F.col
    return [
        ("all", F.lit(True)), ("in_years", c("year").between(1996, 2000)), ("keyed", C.filled(c("key"))), ("linked", c("linked")),
        ("native", c("currency") == "CLP"), ("coded", C.code_class(c("code")) == "valid"), ("returned", c("flag") == "R"),
    ]


def _cascade_sql(variants: dict[str, str]) -> str:
    parts, holds = [], []
    for k, (name, cond) in enumerate(_RUNGS):
        holds.append(f"coalesce({cond}, false)")
        for v, chosen in variants.items():
            w = " AND ".join([*holds, chosen])
            parts.append(f"SELECT {k} AS rung, '{name}' AS step, '{v}' AS variant, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM j WHERE {w}")
    return f"WITH {_LINKED} " + " UNION ALL ".join(parts)


@query(_cascade_sql({"all": "true"}))
def cascade_counts_money(spark, sf_dir):
    """Lines and money down a nested cascade, in one pass."""
    return K.cascade(linked_lines(spark, sf_dir), rungs(), "amount")


@query(_cascade_sql({"raw": "true", "clean": f"NOT {_ERROR}"}))
def cascade_raw_vs_clean(spark, sf_dir):
    """The cascade with and without capture errors, side by side."""
    ok = ~M.capture_error(F.col("price"), F.col("quantity"))
    return K.cascade(linked_lines(spark, sf_dir), rungs(), "amount", {"raw": F.lit(True), "clean": ok})


@query(f"""WITH {_LINKED}, m AS (SELECT 'by_origin' AS list, linked FROM j WHERE coalesce(mechanism NOT IN ('5-LOW'), false) UNION ALL SELECT 'by_document', linked FROM j WHERE coalesce(mechanism NOT IN ('5-LOW', '4-NOT SPECIFIED'), false) UNION ALL SELECT 'none', linked FROM j)
SELECT list, count(*) AS n, count(*) FILTER (WHERE linked) AS n_flag, round(100.0 * count(*) FILTER (WHERE linked) / count(*), 6) AS pct FROM m GROUP BY list""")
def link_rate_by_exclusion_list(spark, sf_dir):
    """The link rate under alternative exclusion lists."""
    from ..operators.link import not_excluded

    m = F.col("mechanism")
    return K.rates_under_lists(linked_lines(spark, sf_dir), F.col("linked"), {"by_origin": not_excluded(m, ["5-LOW"]), "by_document": not_excluded(m, ["5-LOW", "4-NOT SPECIFIED"]), "none": F.lit(True)})


@query(f"""WITH {_LINKED} SELECT mechanism, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, round(100.0 * count(*) FILTER (WHERE coalesce(trim(key) <> '', false)) / count(*), 6) AS keyed_pct,
  round(100.0 * count(*) FILTER (WHERE linked) / count(*), 6) AS linked_pct, round(100.0 * count(*) FILTER (WHERE coalesce({_VALID}, false)) / count(*), 6) AS valid_pct FROM j GROUP BY mechanism ORDER BY n DESC, mechanism LIMIT 30""")
def mechanism_profile(spark, sf_dir):
    """Lines, money and rates of the 30 largest mechanisms."""
    g = linked_lines(spark, sf_dir).groupBy("mechanism")
    pct = lambda c: F.round(100.0 * F.count_if(F.coalesce(c, F.lit(False))) / F.count("*"), 6)
    out = g.agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), pct(C.filled(F.col("key"))).alias("keyed_pct"), pct(F.col("linked")).alias("linked_pct"), pct(C.code_class(F.col("code")) == "valid").alias("valid_pct"))
    return R.top(out, [F.desc("n"), F.asc_nulls_last("mechanism")], 30)


@query(f"""WITH l AS ({LINES}), t AS (SELECT year, sum(CASE WHEN amount > 90000 THEN amount END) AS giant, sum(amount) AS total, count(*) AS n, count(DISTINCT doc) AS n_docs FROM l GROUP BY year)
SELECT year, n, n_docs, CAST(total AS DOUBLE) AS total, CAST(total - coalesce(giant, 0) AS DOUBLE) AS without_giants FROM t""")
def yearly_spend_tail(spark, sf_dir):
    """Yearly spend with and without giant lines; documents."""
    d = lines(spark, sf_dir).groupBy("year", "doc").agg(F.count("*").alias("n"), F.sum("amount").alias("a"), F.sum(F.when(F.col("amount") <= 90000, F.col("amount"))).alias("s"))
    return d.groupBy("year").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.sum("a").cast("double").alias("total"), F.sum("s").cast("double").alias("without_giants"))


@query(f"""WITH l AS ({LINES}), t AS (SELECT year, CAST(sum(amount) AS DOUBLE) AS total, count(DISTINCT doc) AS docs FROM l GROUP BY year), o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS official, count(*) AS official_docs FROM orders GROUP BY 1)
SELECT year, round(total / official, 6) AS money_ratio, round(total * 1.19 / official, 6) AS money_ratio_with_vat, round(CAST(docs AS DOUBLE) / official_docs, 6) AS doc_ratio FROM t JOIN o USING (year)""")
def external_reconciliation(spark, sf_dir):
    """Yardsticks against official totals, also with VAT."""
    t = lines(spark, sf_dir).groupBy("year", "doc").agg(F.sum("amount").alias("a")).groupBy("year").agg(F.sum("a").cast("double").alias("total"), F.count("*").alias("docs"))
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("official"), F.count("*").alias("official_docs"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    return t.join(o, "year").select("year", r(F.col("total"), F.col("official")).alias("money_ratio"), r(F.col("total") * 1.19, F.col("official")).alias("money_ratio_with_vat"), r(F.col("docs"), F.col("official_docs")).alias("doc_ratio"))


@query(f"""WITH l AS (SELECT *, {_ERROR} AS bad, coalesce(abs(CAST(amount AS DOUBLE) - price) > 0.01 * abs(price), false) AS off FROM ({LINES}))
SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_error, CAST(sum(amount) AS DOUBLE) AS raw_total, CAST(sum(CASE WHEN NOT bad THEN amount END) AS DOUBLE) AS clean_total,
  round(100.0 * CAST(sum(CASE WHEN bad THEN amount END) AS DOUBLE) / CAST(sum(amount) AS DOUBLE), 6) AS error_pct, round(100.0 * count(*) FILTER (WHERE off) / count(*), 6) AS off_pct FROM l""")
def error_signature_impact(spark, sf_dir):
    """What capture errors weigh, and lines that differ from their declared amount."""
    c = F.col
    bad = M.capture_error(c("price"), c("quantity"))
    off = F.coalesce(F.abs(c("amount").cast("double") - c("price")) > 0.01 * F.abs(c("price")), F.lit(False))
    total = lambda x: F.sum(x).cast("double")
    s = lines(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_error"), total("amount").alias("raw_total"), total(F.when(~bad, c("amount"))).alias("clean_total"), total(F.when(bad, c("amount"))).alias("e"), F.count_if(off).alias("o"))
    return s.select("n", "n_error", "raw_total", "clean_total", F.round(C.percent(c("e"), c("raw_total")), 6).alias("error_pct"), F.round(C.percent(c("o"), c("n")), 6).alias("off_pct"))


@query(f"""WITH l AS ({LINES}), d AS (SELECT doc, min(year) AS year, max(doc_total) AS t FROM l GROUP BY doc) SELECT year, count(*) AS n_docs, CAST(sum(t) AS DOUBLE) AS total FROM d GROUP BY year""")
def document_totals(spark, sf_dir):
    """Document totals, each document once."""
    d = lines(spark, sf_dir).groupBy("doc").agg(F.min("year").alias("year"), F.max("doc_total").alias("t"))
    return d.groupBy("year").agg(F.count("*").alias("n_docs"), F.sum("t").cast("double").alias("total"))


@query(f"""WITH l AS ({LINES}), d AS (SELECT doc, min(mechanism) AS mechanism, CAST(sum(amount) AS DOUBLE) AS lt, CAST(max(doc_total) AS DOUBLE) AS dt FROM l GROUP BY doc), r AS (SELECT mechanism, lt / dt AS ratio FROM d)
SELECT mechanism, count(*) AS n_docs, count(*) FILTER (WHERE abs(ratio - 1) > 0.01) AS n_outside, round(quantile_cont(ratio, 0.25), 6) AS q1, round(quantile_cont(ratio, 0.5), 6) AS q2, round(quantile_cont(ratio, 0.75), 6) AS q3 FROM r GROUP BY mechanism""")
def doc_reconciliation(spark, sf_dir):
    """The sum of a document's lines against its declared total."""
    d = M.reconcile_documents(lines(spark, sf_dir), "doc", "amount", "doc_total", more=(F.min("mechanism").alias("mechanism"),))
    d = d.withColumn("mechanism", F.coalesce("mechanism", F.lit("")))
    g = d.groupBy("mechanism").agg(F.count("*").alias("n_docs"), F.count_if("outside").alias("n_outside")).join(R.quantiles(d, ["mechanism"], "ratio", [0.25, 0.5, 0.75]), "mechanism", "left")
    g = g.withColumn("mechanism", F.nullif("mechanism", F.lit("")))
    return g.select("mechanism", "n_docs", "n_outside", *(F.round(F.col("q")[k], 6).alias(f"q{k + 1}") for k in range(3)))


def _concentration_sql() -> str:
    parts = []
    for m in ("lines", "spend", "clean"):
        for by in ("lines", "spend", "clean"):
            for n in (10, 50, 100, 300):
                parts.append(f"SELECT '{m}' AS measure, '{by}' AS ranked_by, {n} AS top, round(100.0 * sum(CASE WHEN r_{by} <= {n} THEN {m} END) / sum({m}), 6) AS share FROM r")
    ranks = ", ".join(f"CASE WHEN {b} IS NOT NULL THEN row_number() OVER (ORDER BY {b} DESC NULLS LAST, code) END AS r_{b}" for b in ("lines", "spend", "clean"))
    return f"""WITH g AS (SELECT code, CAST(count(*) AS DOUBLE) AS lines, CAST(sum(amount) AS DOUBLE) AS spend, CAST(sum(CASE WHEN NOT {_ERROR} THEN amount END) AS DOUBLE) AS clean FROM ({LINES}) WHERE code IS NOT NULL GROUP BY code),
r AS (SELECT *, {ranks} FROM g) """ + " UNION ALL ".join(parts)


@query(_concentration_sql())
def concentration_topn(spark, sf_dir):
    """Shares of the first N codes, of lines, of money raw and clean, ranked by each."""
    c = F.col
    ok = ~M.capture_error(c("price"), c("quantity"))
    return M.concentration(lines(spark, sf_dir), "code", {"lines": F.lit(1.0), "spend": c("amount"), "clean": F.when(ok, c("amount"))})


@query(f"WITH l AS ({LINES}) SELECT measure, count(*) AS n, count(DISTINCT code) AS n_codes, CASE measure WHEN 'kg' THEN false ELSE true END AS comparable FROM l GROUP BY measure ORDER BY n DESC, measure LIMIT 40")
def measure_frequency(spark, sf_dir):
    """Units of measure by frequency, and which of them compare."""
    g = lines(spark, sf_dir).groupBy("measure").agg(F.count("*").alias("n"), F.count_distinct("code").alias("n_codes"))
    return R.top(g.withColumn("comparable", C.comparable_unit(F.col("measure"), ["KG", "GLOBAL"])), [F.desc("n"), F.asc("measure")], 40)


@query(f"""WITH l AS ({LINES}), g AS (SELECT mechanism, measure, year, count(*) AS n, count(DISTINCT entity) AS n_entities, quantile_cont(price, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM l WHERE price >= 100 AND measure NOT IN ('KG') GROUP BY ALL)
SELECT mechanism, measure, year, n, n_entities, round(q[3], 4) AS median, round(q[4] / q[2], 6) AS p75_p25, round(q[5] / q[1], 6) AS p90_p10 FROM g WHERE n >= 100 AND n_entities >= 5""")
def price_dispersion(spark, sf_dir):
    """Price quantiles and their ratios in cells of enough rows and entities."""
    return M.dispersion(lines(spark, sf_dir), ["mechanism", "measure", "year"], "price", "entity", 100, 5, 100)


@query(f"""WITH l AS ({LINES}), n AS (SELECT code, flag, count(*) AS n FROM l WHERE code IS NOT NULL AND flag IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, flag) AS rk, sum(n) OVER (PARTITION BY code) AS t FROM n)
SELECT code, max(CASE WHEN rk = 1 THEN flag END) AS dominant, max(CASE WHEN rk = 2 THEN flag END) AS runner_up, CAST(max(t) AS BIGINT) AS n, round(100.0 * max(CASE WHEN rk = 1 THEN n END) / max(t), 6) AS share,
  round(100.0 * max(CASE WHEN rk = 1 THEN n END) / max(t), 6) < 60 AS weak FROM r WHERE rk <= 2 GROUP BY code""")
def dominant_label(spark, sf_dir):
    """Each code's dominant label, its share and the runner-up."""
    return M.dominant_label(lines(spark, sf_dir), "code", "flag")


@query(f"""SELECT doc, line, year, CAST(amount AS DOUBLE) AS amount, coalesce(price = quantity AND price > 1000, false) AS error FROM ({LINES}) WHERE {_ERROR} OR amount > 100000 ORDER BY amount DESC, doc, line LIMIT 20""")
def extreme_lines(spark, sf_dir):
    """The largest lines and those with the error signature."""
    bad = M.capture_error(F.col("price"), F.col("quantity"))
    rows = lines(spark, sf_dir).where(bad | (F.col("amount") > 100000)).select("doc", "line", "year", F.col("amount").cast("double").alias("amount"), bad.alias("error"))
    return R.top(rows, [F.desc("amount"), F.asc("doc"), F.asc("line")], 20)
