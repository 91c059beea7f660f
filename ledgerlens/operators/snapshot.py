"""Comparison of dated snapshots: gains, losses, duplicates, censoring, maturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import percent


def consolidate(rows: DataFrame, key: str, values: list[str], flags: list[str] = ()) -> DataFrame:
    """One row a key: rows, the least non-NULL value of each field (a stand-in for the first,
    which has no order), and whether any row has each flag."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), *(F.min(v).alias(v) for v in values), *(F.bool_or(f).alias(f) for f in flags))


def diff(old: DataFrame, new: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row a key of either snapshot: presence, and for each field whether a common key
    gained or lost it. Give consolidated snapshots; fields maps a name to its column."""
    a = old.select(key, F.lit(True).alias("_a"), *(F.col(c).isNotNull().alias(f"_a_{n}") for n, c in fields.items()))
    b = new.select(key, F.lit(True).alias("_b"), *(F.col(c).isNotNull().alias(f"_b_{n}") for n, c in fields.items()))
    j = a.join(b, key, "full_outer")
    common = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changes = [c for n in fields for c in ((common & ~F.col(f"_a_{n}") & F.col(f"_b_{n}")).alias(f"gained_{n}"), (common & F.col(f"_a_{n}") & ~F.col(f"_b_{n}")).alias(f"lost_{n}"))]
    side = F.when(F.col("_b").isNull(), "only_old").when(F.col("_a").isNull(), "only_new").otherwise("common")
    return j.select(key, side.alias("side"), *changes)


def diff_metrics(diffed: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, metric, value): the diff in long form, from one aggregate."""
    sums = {s: F.count_if(F.col("side") == s) for s in ("only_old", "only_new", "common")}
    sums |= {f"{w}_{n}": F.count_if(F.coalesce(F.col(f"{w}_{n}"), F.lit(False))) for n in fields for w in ("gained", "lost")}
    g = diffed.groupBy(by).agg(*(c.alias(n) for n, c in sums.items()))
    return g.unpivot([by], list(sums), "metric", "value")


def accept(metrics: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Per metric with a limit: its sum over all groups, the limit, and whether it is kept."""
    m = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    g = metrics.where(F.col("metric").isin(list(limits))).groupBy("metric").agg(F.sum("value").alias("value"))
    return g.withColumn("most", m[F.col("metric")]).withColumn("ok", F.col("value") <= F.col("most"))


def duplicate_factor(rows: DataFrame, part: str, key: list[str]) -> DataFrame:
    """Per partition: rows over distinct natural keys. NULL parts of a key are values."""
    g = rows.groupBy(part, *key).agg(F.count("*").alias("n"))
    s = g.groupBy(part).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.max("n").alias("most"))
    return s.withColumn("factor", F.round(F.try_divide("n_rows", "n_keys"), 6))


def redownload_profile(rows: DataFrame, part: str, doc: str, amounts: list[str], code: str, frozen: DataFrame, bands: tuple[float, float] = (2.0, 15.0)) -> DataFrame:
    """Per partition: rows, documents, literally repeated rows, sums, rows without a code,
    and how far the rows are from frozen counts (part, frozen_rows)."""
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns])
    d = rows.withColumn("_d", digest).groupBy(part, doc, "_d").agg(F.count("*").alias("n"), F.count_if(F.col(code).isNull()).alias("z"), *(F.sum(a).alias(f"s_{a}") for a in amounts))
    per_doc = d.groupBy(part, doc).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dup"), F.sum("z").alias("z"), *(F.sum(f"s_{a}").alias(f"s_{a}") for a in amounts))
    g = per_doc.groupBy(part).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_docs"), F.sum("dup").alias("repeated_rows"), F.sum("z").alias("without_code"), *(F.sum(f"s_{a}").cast("double").alias(f"sum_{a}") for a in amounts))
    g = g.withColumn("lines_per_doc", F.round(F.try_divide("n_rows", "n_docs"), 6)).join(frozen, part, "left")
    delta = percent(F.col("n_rows") - F.col("frozen_rows"), F.col("frozen_rows"))
    band = F.when(delta.isNull(), "no_reference").when(F.abs(delta) <= bands[0], "same").when(F.abs(delta) <= bands[1], "moved").otherwise("different")
    return g.withColumn("delta_pct", F.round(delta, 6)).withColumn("band", band)


def download_calendar(rows: DataFrame, key: str, published: str, awarded: str, supplier: str, bidders: str) -> DataFrame:
    """Per publication month: keys, and how many have an award date, a supplier, a bidder;
    the last dates and the days between them. Rows are reduced to keys first, so that no
    distinct count multiplies them; unreadable months are a row of their own."""
    k = rows.groupBy(key).agg(
        F.min(published).alias("p"), F.max(awarded).alias("a"), F.bool_or(F.col(awarded).isNotNull()).alias("has_award"), F.bool_or(F.col(supplier).isNotNull()).alias("has_supplier"), F.bool_or(F.coalesce(F.col(bidders) > 0, F.lit(False))).alias("has_bidders")
    )
    g = k.groupBy(F.date_format("p", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_keys"), *(F.count_if(c).alias(c) for c in ("has_award", "has_supplier", "has_bidders")), F.max("p").alias("lp"), F.max("a").alias("la")
    )
    return g.select("month", "n_keys", "has_award", "has_supplier", "has_bidders", F.col("lp").cast("string").alias("last_published"), F.col("la").cast("string").alias("last_awarded"), F.datediff("la", "lp").alias("maturity_days"))


def superset_by_count(side_by_side: DataFrame, year: str) -> DataFrame:
    """Per year: old and new counts, and whether the new one has at least as many everywhere."""
    g = side_by_side.groupBy(year).agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"), F.count_if(F.col("delta") < 0).alias("months_less"))
    return g.withColumn("verdict", F.when(F.col("months_less") == 0, "superset").when(F.col("n_new") >= F.col("n_old"), "mixed").otherwise("less"))


def in_period(year: Column, month: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Whether a (year, month) lies in a period, both ends included; NULL months do not."""
    n = year * 12 + month
    return F.coalesce(n.between(first[0] * 12 + first[1], last[0] * 12 + last[1]), F.lit(False))


def lag_quantiles(rows: DataFrame, by: list[str], lag: Column, prefix: str = "lag") -> DataFrame:
    """Median and 90th percentile of a lag by its order statistics. Lags are counted by value
    first: what meets in a group is the distinct days, whose number is bounded by the calendar."""
    n = rows.select(*by, lag.alias("_lag")).where("_lag is not null").groupBy(*by, "_lag").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    c = n.withColumn("_c", F.sum("_n").over(w.orderBy("_lag").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_t", F.sum("_n").over(w))
    at = lambda p: F.min(F.when(F.col("_c") > F.least(F.floor(F.col("_t") * p), F.col("_t") - 1), F.col("_lag")))
    return c.groupBy(*by).agg(F.max("_t").alias(f"{prefix}_n"), at(0.5).alias(f"{prefix}_median"), at(0.9).alias(f"{prefix}_p90"), F.max("_lag").alias(f"{prefix}_max"))


def censoring(rows: DataFrame, year: str, published: str, event: str, cut: str) -> DataFrame:
    """Per publication year: events seen, absent, and present but after the cut date, with
    the lag of those seen; ``no_leverage`` where nothing lies after the cut."""
    c = F.lit(cut).cast("date")
    g = rows.groupBy(year).agg(
        F.count("*").alias("n"), F.count_if(F.col(event).isNull()).alias("absent"), F.count_if(F.coalesce(F.col(event) > c, F.lit(False))).alias("censored"), F.count_if(F.coalesce(F.col(event) <= c, F.lit(False))).alias("seen")
    )
    q = lag_quantiles(rows.where(F.col(event) <= c), [year], F.datediff(event, published))
    return g.join(q, year, "left").withColumn("no_leverage", F.col("censored") == 0)


def lost_keys(old: DataFrame, new: DataFrame, key: str, by: list[str], state: str) -> DataFrame:
    """Per group: old, new, common, lost and gained keys, and the share of a state among lost
    and among common ones is given by lost_states."""
    a, b = old.select(key, *by).withColumn("_a", F.lit(1)), new.select(key, *by).withColumn("_b", F.lit(1))
    j = a.join(b, [key, *by], "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.groupBy(*by).agg(F.count("_a").alias("n_old"), F.count("_b").alias("n_new"), F.count_if(both).alias("common"), F.count_if(F.col("_b").isNull()).alias("lost"), F.count_if(F.col("_a").isNull()).alias("gained"))


def lost_states(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """State mix of lost against common keys, in per cent of each."""
    j = old.select(key, state).join(new.select(key).distinct().withColumn("_b", F.lit(1)), key, "left")
    g = j.groupBy(F.when(F.col("_b").isNull(), "lost").otherwise("common").alias("side"), state).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(percent(F.col("n"), F.sum("n").over(Window.partitionBy("side"))), 6))


def date_profile(rows: DataFrame, columns: dict[str, Column], base: Column, today: str) -> DataFrame:
    """Per date column (text read to a date): filled, in the future, first, last, and the lag
    from a base date. One unpivot instead of a pass for each column."""
    long = rows.select(base.alias("_base"), F.explode(F.array(*(F.struct(F.lit(n).alias("column"), c.alias("d")) for n, c in columns.items()))).alias("x")).select("_base", "x.*")
    lag = F.datediff("d", "_base")
    g = long.groupBy("column").agg(
        F.count("*").alias("n"), F.count("d").alias("filled"), F.min("d").cast("string").alias("first_date"), F.max("d").cast("string").alias("last_date"),
        F.count_if(F.col("d") > F.lit(today).cast("date")).alias("in_future"), F.count_if(lag < 0).alias("negative"),
    )
    return g.join(lag_quantiles(long, ["column"], lag), "column", "left").withColumn("filled_pct", F.round(percent(F.col("filled"), F.col("n")), 6))


def maturation(rows: DataFrame, key: str, period: list[str], published: str, awarded: str, reference: str) -> DataFrame:
    """Per monthly file: keys, the share with an award date, those dated after the reference
    day, lag quantiles and the file's age in months. Rows are reduced to keys first."""
    k = rows.groupBy(*period, key).agg(F.min(published).alias("p"), F.min(awarded).alias("a"))
    ref = F.lit(reference).cast("date")
    g = k.groupBy(*period).agg(F.count("*").alias("n_keys"), F.count("a").alias("with_date"), F.count_if(F.col("a") > ref).alias("in_future"))
    age = F.floor(F.months_between(ref, F.make_date(F.col(period[0]), F.col(period[1]), F.lit(1)))).cast("int")
    out = g.join(lag_quantiles(k, period, F.datediff("a", "p")), period, "left")
    return out.withColumn("with_date_pct", F.round(percent(F.col("with_date"), F.col("n_keys")), 6)).withColumn("age_months", age)


def imputation_test(rows: DataFrame, key: str, actual: str, estimated: str, control: Column, limits: tuple[float, float] = (30.0, 10.0)) -> DataFrame:
    """One row: how often the actual date equals the estimated one, among the control group
    and the others; the difference in points, and what it says."""
    k = rows.groupBy(key).agg(F.min(actual).alias("a"), F.min(estimated).alias("e"), F.bool_or(control).alias("c")).where("a is not null and e is not null")
    same = (F.col("a") == F.col("e")).cast("int")
    g = k.agg(F.count_if("c").alias("n_control"), F.count_if(~F.col("c")).alias("n_other"), (100 * F.avg(F.when(F.col("c"), same))).alias("x"), (100 * F.avg(F.when(~F.col("c"), same))).alias("y"))
    d = F.col("y") - F.col("x")
    return g.select("n_control", "n_other", F.round("x", 6).alias("control_pct"), F.round("y", 6).alias("other_pct"), F.round(d, 6).alias("difference"), F.when(d >= limits[0], "imputed").when(d >= limits[1], "suspect").otherwise("no_sign").alias("verdict"))
