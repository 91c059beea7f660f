"""Queries of series, panels, placebos, overflow and shift-share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import link as L
from ..operators import series as Y
from .registry import query
from .standin import LINES, lines, snapshot, snapshot_sql

_V = "coalesce(regexp_full_match(code, '[0-9]{8}') AND NOT regexp_full_match(code, '0+'), false)"
_RATES = f"round(100.0 * avg(CASE WHEN {_V} THEN 1 ELSE 0 END), 6) AS valid_pct, round(100.0 * avg(CASE WHEN coalesce(measure = 'unit', false) THEN 1 ELSE 0 END), 6) AS placebo_measure, round(100.0 * avg(CASE WHEN coalesce(flag = 'N', false) THEN 1 ELSE 0 END), 6) AS placebo_flag"
_YEARS = list(range(1995, 2002))


def rates():
    return {"valid_pct": C.code_class(F.col("code")) == "valid", "placebo_measure": F.col("measure") == "unit", "placebo_flag": F.col("flag") == "N"}


@query(f"WITH l AS ({LINES}) SELECT year, count(*) AS n, count(DISTINCT unit) AS n_entities, {_RATES} FROM l GROUP BY year")
def yearly_validity_series(spark, sf_dir):
    """Yearly validity with two placebo fields and the entities seen."""
    return Y.yearly(lines(spark, sf_dir), "year", rates(), "unit")


@query(f"""WITH l AS ({LINES}), b AS (SELECT unit FROM l WHERE year BETWEEN 1995 AND 2001 GROUP BY unit HAVING count(DISTINCT year) = 7)
SELECT 'full' AS series, year, count(*) AS n, count(DISTINCT unit) AS n_entities, {_RATES} FROM l GROUP BY year
UNION ALL SELECT 'balanced', year, count(*), count(DISTINCT unit), {_RATES} FROM l SEMI JOIN b USING (unit) WHERE year BETWEEN 1995 AND 2001 GROUP BY year""")
def balanced_panel_series(spark, sf_dir):
    """The series over all entities and over those seen every year."""
    return Y.panel(lines(spark, sf_dir), "year", _YEARS, rates(), "unit")


@query(f"""WITH l AS ({LINES}), b AS (SELECT unit FROM l WHERE year IN (1998, 1999) GROUP BY unit HAVING count(DISTINCT year) = 2)
SELECT year, count(*) AS n, count(DISTINCT unit) AS n_entities, {_RATES} FROM l SEMI JOIN b USING (unit) WHERE year IN (1998, 1999) GROUP BY year""")
def restricted_series(spark, sf_dir):
    """Two years compared over entities present in both."""
    return Y.yearly(L.in_all(lines(spark, sf_dir), "unit", "year", [1998, 1999]), "year", rates(), "unit")


@query(f"WITH l AS ({LINES}) SELECT year, mechanism, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM l GROUP BY 1, 2")
def year_mechanism_composition(spark, sf_dir):
    """Lines and money by year and mechanism."""
    return lines(spark, sf_dir).groupBy("year", "mechanism").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(f"""WITH c AS (SELECT unit, year, count(*) AS n, count(*) FILTER (WHERE {_V}) AS k FROM ({LINES}) GROUP BY 1, 2),
p AS (SELECT * FROM (VALUES (1995, 1996), (1996, 1997), (1997, 1998), (1998, 1999), (1999, 2000)) t(y0, y1)),
j AS (SELECT y0, y1, a.unit, a.n AS n0, a.k AS k0, b.n AS n1, b.k AS k1 FROM p JOIN c a ON a.year = y0 JOIN c b ON b.year = y1 AND b.unit = a.unit)
SELECT y0, y1, count(*) AS n_entities, round(100.0 * sum(k0) / sum(n0), 6) AS before_pct, round(100.0 * sum(k1) / sum(n1), 6) AS after_pct, round(100.0 * sum(k1) / sum(n1) - 100.0 * sum(k0) / sum(n0), 6) AS delta FROM j GROUP BY 1, 2""")
def placebo_year_pairs(spark, sf_dir):
    """The restricted change for the pair of interest and for placebo pairs."""
    pairs = [(y, y + 1) for y in range(1995, 2000)]
    return Y.placebo_pairs(lines(spark, sf_dir), "year", pairs, "unit", C.code_class(F.col("code")) == "valid")


@query(f"""WITH l AS ({LINES}), u AS (SELECT CAST(year AS VARCHAR) AS part, year, ship_year FROM l UNION ALL SELECT 'all', year, ship_year FROM l)
SELECT part, count(*) AS n, count(*) FILTER (WHERE coalesce(year <> ship_year, false)) AS n_out, count(*) FILTER (WHERE ship_year IS NULL) AS n_unknown, round(100.0 * count(*) FILTER (WHERE coalesce(year <> ship_year, false)) / count(*), 6) AS pct FROM u GROUP BY part""")
def year_overflow(spark, sf_dir):
    """Records whose own year is not their partition's."""
    return Y.overflow(lines(spark, sf_dir), "year", "ship_year")


@query(f"""WITH l AS ({LINES}), c AS (SELECT mechanism, count(*) FILTER (WHERE year = 1996) AS n0, count(*) FILTER (WHERE year = 2000) AS n1, count(*) FILTER (WHERE year = 1996 AND {_V}) AS k0, count(*) FILTER (WHERE year = 2000 AND {_V}) AS k1 FROM l WHERE year IN (1996, 2000) GROUP BY 1),
s AS (SELECT mechanism AS member, 100.0 * n0 / sum(n0) OVER () AS w0, 100.0 * n1 / sum(n1) OVER () AS w1, coalesce(CAST(k0 AS DOUBLE) / nullif(n0, 0), 0) AS r0, coalesce(CAST(k1 AS DOUBLE) / nullif(n1, 0), 0) AS r1 FROM c),
p AS (SELECT member, (w1 - w0) * r0 AS a, w0 * (r1 - r0) AS b, (w1 - w0) * (r1 - r0) AS c, w1 * r1 - w0 * r0 AS t FROM s)
SELECT member, round(sum(a), 6) AS composition, round(sum(b), 6) AS behaviour, round(sum(c), 6) AS interaction, round(sum(t), 6) AS total FROM p GROUP BY member
UNION ALL SELECT 'ALL', round(sum(a), 6), round(sum(b), 6), round(sum(c), 6), round(sum(t), 6) FROM p""")
def shift_share(spark, sf_dir):
    """A change of rate split into composition, behaviour and interaction."""
    return Y.shift_share(lines(spark, sf_dir), "year", "mechanism", C.code_class(F.col("code")) == "valid", 1996, 2000)


@query(f"""WITH a AS (SELECT year, month, count(*) AS n FROM ({snapshot_sql(2)}) GROUP BY 1, 2), b AS (SELECT year, month, count(*) AS n FROM ({snapshot_sql(1)}) WHERE NOT (year = 1997 AND month = 5) GROUP BY 1, 2),
j AS (SELECT coalesce(a.year, b.year) AS year, coalesce(a.n, 0) AS o, coalesce(b.n, 0) AS w FROM a FULL JOIN b USING (year, month)),
f AS (SELECT *, o > 0 AND w > 0 AND 100.0 * (o - w) > 2.0 * o AS fell FROM j)
SELECT CAST(sum(greatest(o - w, 0)) AS BIGINT) AS deficit, count(*) FILTER (WHERE o > 0 AND w = 0) AS missing, count(*) FILTER (WHERE fell) AS declines, count(*) FILTER (WHERE o = 0 AND w > 0) AS new_only, count(*) FILTER (WHERE fell AND year >= 2000) AS recent_declines,
  round(100.0 * count(*) FILTER (WHERE fell AND year >= 2000) / count(*) FILTER (WHERE fell), 6) AS recent_pct, coalesce(100.0 * count(*) FILTER (WHERE fell AND year >= 2000) / count(*) FILTER (WHERE fell) >= 60, false) AS localised FROM f""")
def deficit_localisation(spark, sf_dir):
    """Where a new download has fewer rows."""
    new = snapshot(spark, sf_dir, 1).where(~((F.col("year") == 1997) & (F.col("month") == 5)))
    return Y.deficit(L.counts_side_by_side(snapshot(spark, sf_dir, 2), new, ["year", "month"]), F.col("year") >= 2000)
