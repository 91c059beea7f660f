"""Stratified association and agreement between raters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959964


def contingency(rows: DataFrame, strata: list[str], predictors: dict[str, Column], outcome: Column) -> DataFrame:
    """(strata, predictor, a, b, c, d): 2 x 2 counts of each predictor (placebos too) against
    the outcome, in one pass: a both, b predictor only, c outcome only, d neither. Rows where
    one of the two is NULL are left out of its table."""
    marked = rows.select(*strata, outcome.cast("boolean").alias("_y"), *(p.cast("boolean").alias(f"_p_{n}") for n, p in predictors.items()))
    sums = []
    for n in predictors:
        x, y = F.col(f"_p_{n}"), F.col("_y")
        sums.append(F.struct(F.lit(n).alias("predictor"), F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d")))
    g = marked.groupBy(*strata).agg(F.array(*sums).alias("t"))
    return g.select(*strata, F.explode("t").alias("x")).select(*strata, "x.*")


def mantel_haenszel(cells: DataFrame, by: str = "predictor", least: int = 30) -> DataFrame:
    """Per predictor: crude odds ratio, pooled odds ratio with its 95 % interval
    (Robins-Breslow-Greenland), strata used and dropped (fewer than ``least`` rows, or no
    variation). An undefined ratio is NULL."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    usable = (n >= least) & (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)
    p, q, r, s = (a + d) / n, (b + c) / n, a * d / n, b * c / n
    when = lambda x: F.sum(F.when(usable, x))
    g = cells.where(n > 0).groupBy(by).agg(
        F.count_if(usable).alias("used"), F.count_if(~usable).alias("dropped"), when(n).alias("n"), when(a).alias("a"), when(b).alias("b"), when(c).alias("c"), when(d).alias("d"),
        when(r).alias("r"), when(s).alias("s"), when(p * r).alias("pr"), when(p * s + q * r).alias("psqr"), when(q * s).alias("qs"),
    )
    col = F.col
    odds = F.when((col("r") > 0) & (col("s") > 0), col("r") / col("s"))
    var = col("pr") / (2 * col("r") * col("r")) + col("psqr") / (2 * col("r") * col("s")) + col("qs") / (2 * col("s") * col("s"))
    se = F.sqrt(var)
    crude = F.try_divide(col("a") * col("d"), F.when(col("b") * col("c") > 0, col("b") * col("c")))
    bound = lambda sign: F.round(F.when(odds.isNotNull(), F.exp(F.ln(odds) + sign * Z95 * se)), 4)
    return g.select(by, "used", "dropped", col("n").cast("long").alias("n"), F.round(crude, 4).alias("crude_or"), F.round(odds, 4).alias("pooled_or"), bound(-1).alias("low"), bound(1).alias("high"))


def mh_verdict(pooled: DataFrame, placebo: str, magnitude: float = 1.5, tolerance: float = 0.1) -> DataFrame:
    """Per predictor: sign, magnitude, whether the interval excludes one, and whether the
    placebo stayed near one."""
    ok = pooled.where(F.col("predictor") == placebo).agg(F.bool_and(F.abs(F.col("pooled_or") - 1) <= tolerance).alias("placebo_ok"))
    sign = F.when(F.col("pooled_or").isNull(), "undefined").when(F.col("pooled_or") > 1, "positive").otherwise("negative")
    return pooled.join(ok).select("predictor", sign.alias("sign"), F.coalesce(F.col("pooled_or") >= magnitude, F.lit(False)).alias("large"), F.coalesce((F.col("low") > 1) | (F.col("high") < 1), F.lit(False)).alias("excludes_one"), "placebo_ok")


def cohen_kappa(rows: DataFrame, one: str, other: str) -> DataFrame:
    """One row: the 2 x 2 table of two binary raters, agreement, kappa and its standard
    error; NULL where it is undefined."""
    x, y = F.col(one) == 1, F.col(other) == 1
    g = rows.where(F.col(one).isNotNull() & F.col(other).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither")
    )
    c = F.col
    po = F.try_divide(c("both") + c("neither"), c("n"))
    p1, p2 = F.try_divide(c("both") + c("first_only"), c("n")), F.try_divide(c("both") + c("second_only"), c("n"))
    pe = p1 * p2 + (1 - p1) * (1 - p2)
    kappa = F.try_divide(po - pe, F.when(pe < 1, 1 - pe))
    se = F.sqrt(F.try_divide(po * (1 - po), c("n") * (1 - pe) * (1 - pe)))
    return g.select("n", "both", "first_only", "second_only", "neither", F.round(100 * po, 6).alias("agreement_pct"), F.round(kappa, 6).alias("kappa"), F.round(se, 6).alias("se"))


def ordinal_kappa(rows: DataFrame, one: str, other: str, levels: int) -> DataFrame:
    """One row: kappa of two ordinal raters (0 to levels - 1), plain and with quadratic
    weights, from their joint counts."""
    n = rows.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(one).alias("i"), F.col(other).alias("j")).agg(F.count("*").cast("double").alias("n"))
    left, right = n.groupBy("i").agg(F.sum("n").alias("ni")), n.groupBy("j").agg(F.sum("n").alias("nj"))
    w2 = lambda a, b: F.pow(F.lit(1.0) * (F.col(a) - F.col(b)) / (levels - 1), 2)
    seen = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("i") != F.col("j"), F.col("n")).otherwise(0.0)).alias("o1"), F.sum(F.col("n") * w2("i", "j")).alias("o2"))
    # the margins have ``levels`` rows each: their product is the table of expected counts
    exp = left.withColumn("k", F.lit(1)).join(right.withColumn("k", F.lit(1)), "k").agg(F.sum(F.when(F.col("i") != F.col("j"), F.col("ni") * F.col("nj")).otherwise(0.0)).alias("e1"), F.sum(F.col("ni") * F.col("nj") * w2("i", "j")).alias("e2"))
    k = lambda o, e: F.round(1 - F.try_divide(F.col(o) * F.col("t"), F.when(F.col(e) > 0, F.col(e))), 6)
    return seen.join(exp).select(F.col("t").cast("long").alias("n"), k("o1", "e1").alias("kappa"), k("o2", "e2").alias("quadratic_kappa"))


def mcnemar_exact(table: DataFrame, b: str = "first_only", c: str = "second_only") -> DataFrame:
    """The exact two-sided McNemar p of discordant counts b and c (one row in, one out). The
    binomial tail is a sum of exponentials of log-factorials, itself an aggregate."""
    low, n = F.least(b, c), F.col(b) + F.col(c)
    logs = F.aggregate(
        F.sequence(F.lit(0).cast("long"), low.cast("long")),
        F.struct(F.lit(0.0).alias("logc"), F.lit(0.0).alias("sum")),
        lambda acc, k: F.struct(
            (acc["logc"] + F.when(k > 0, F.ln((n - k + 1).cast("double")) - F.ln(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)).alias("logc"),
            (acc["sum"] + F.exp(acc["logc"] + F.when(k > 0, F.ln((n - k + 1).cast("double")) - F.ln(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0) - n * math.log(2))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * logs))
    return table.withColumn("discordant", n).withColumn("p", F.round(p, 6))


def discordance_by_group(rows: DataFrame, group: str, one: str, other: str, least: int = 10) -> DataFrame:
    """Per group of enough rows, the others pooled: discordant pairs in per cent."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(one) != F.col(other)).alias("k"))
    label = F.when(F.col("n") >= least, F.col(group)).otherwise(F.lit("(other)"))
    return g.groupBy(label.alias("group")).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("group", "n", F.round(100.0 * F.col("k") / F.col("n"), 6).alias("discordant_pct"))
