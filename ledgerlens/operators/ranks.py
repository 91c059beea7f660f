"""Row numbers and rank shares that do not put a large stratum into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled


def digest_rank(rows: DataFrame, strata: list[str], digest: str, into: str, tie: list[str] | None = None) -> DataFrame:
    """row_number over the strata in the order of a hexadecimal digest.

    Digests are uniform, so their first two digits deal each stratum into 256 ranges of
    about equal size, in order. Rows are numbered inside a range, and the sizes of the
    ranges before it are added: equal to one window over the stratum, but no task sees more
    than a range of it."""
    part = F.substring(digest, 1, 2)
    rows = rows.withColumn("_range", part)
    sizes = rows.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most 256 sizes for a stratum
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    named = offsets.select(*(F.col(s).alias(f"_s_{s}") for s in strata), F.col("_range").alias("_r"), "_before")
    on = (F.col("_range") == F.col("_r")) & _same(strata)
    inside = Window.partitionBy(*strata, "_range").orderBy(digest, *(tie or []))
    numbered = rows.withColumn("_k", F.row_number().over(inside))
    return numbered.join(named, on).withColumn(into, (F.col("_k") + F.col("_before")).cast("long")).drop("_range", "_r", "_k", "_before", *(f"_s_{s}" for s in strata))


def _same(strata: list[str]) -> Column:
    out = F.lit(True)
    for s in strata:
        out = out & F.col(s).eqNullSafe(F.col(f"_s_{s}"))
    return out


def prefix_sums(rows: DataFrame, groups: list[str], order: list[Column], weight: Column | None = None, before: str = "_before", total: str = "_total") -> DataFrame:
    """rows with the sum of the weights (default: the number) of the rows of their group that
    come before them, and of the whole group. The order has to settle ties.

    Equal to two windows over the group, but no task holds one: Spark samples range bounds of (group,
    order), so large groups get more ranges and small ones share them; rows are summed inside
    their range, and the sums of the group's ranges before are added. The ranges are written
    once, so that both sides see the same ones."""
    w = F.lit(1) if weight is None else weight
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_w", w).repartitionByRange(ranges, *(F.col(g).asc_nulls_first() for g in groups), *order)
    dealt = settled(dealt.withColumn("_range", F.spark_partition_id()))
    # at most one row for each range and group
    sizes = dealt.groupBy(*groups, "_range").agg(F.sum("_w").alias("_n"))
    over = Window.partitionBy(*groups)
    below = F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(g).alias(f"_s_{g}") for g in groups), F.col("_range").alias("_r"), below.alias("_lower"), F.sum("_n").over(over).alias(total))
    inside = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn(before, F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(offsets, (F.col("_range") == F.col("_r")) & _same(groups))
    return out.withColumn(before, F.col(before) + F.col("_lower")).drop("_w", "_range", "_r", "_lower", *(f"_s_{g}" for g in groups))


def top(rows: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The k first rows; give enough columns that ties are settled."""
    return rows.orderBy(*by).limit(k)


def first_per_group(rows: DataFrame, group: list[str], by: list[Column], k: int = 1, into: str | None = None) -> DataFrame:
    """The k first rows of each group (pruned before the shuffle)."""
    name = into or "_rk"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col(name) <= k)
    return out if into else out.drop(name)


def average_rank_share(rows: DataFrame, strata: list[str], value: str, into: str = "rank_share") -> DataFrame:
    """Rank of a value inside its stratum over the stratum's size, ties sharing their mean
    rank (NULL values have none). Equal values are counted first, and ranks are sums before
    them, so that no task holds a stratum."""
    known = rows.where(F.col(value).isNotNull()).groupBy(*strata, value).agg(F.count("*").alias("_n"))
    shares = prefix_sums(known, strata, [F.col(value)], F.col("_n")).withColumn("_share", (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_total"))
    named = shares.select(*(F.col(s).alias(f"_s_{s}") for s in strata), F.col(value).alias("_v"), F.col("_share").alias(into))
    return rows.join(named, _same(strata) & (F.col(value) == F.col("_v")), "left").drop("_v", *(f"_s_{s}" for s in strata))


def weighted_median(rows: DataFrame, value: str, weight: str, strata: list[str] | None = None) -> DataFrame:
    """Per stratum: the first value, in order, at which the weights so far reach half."""
    strata = strata or []
    sums = rows.where(F.col(value).isNotNull()).groupBy(*strata, value).agg(F.sum(weight).alias("_sum"))
    reached = prefix_sums(sums, strata, [F.col(value)], F.col("_sum")).where(2 * (F.col("_before") + F.col("_sum")) >= F.col("_total"))
    return reached.groupBy(*strata).agg(F.min(value).alias("weighted_median"))


def even_spread(rows: DataFrame, groups: list[str], order: list[Column], quota: int) -> DataFrame:
    """About ``quota`` rows of each group, evenly spaced along the order; a group with fewer
    rows gives all of them. Every step-th row is on the way, and with a step of at most n / quota
    there are ``quota`` of them, so the first ones are the result."""
    n = prefix_sums(rows, groups, order)
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / quota))
    return n.where((F.col("_before") % step == 0) & (F.col("_before") < step * quota)).drop("_before", "_total")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and q, the exact interpolated quantiles of a value in each group. Values are counted
    first, and their places are sums before them over ranges of values: a group's values,
    however many, are spread over tasks, and only those at a quantile's place go on."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    c = prefix_sums(n, by, [F.col(value)], F.col("_n"))
    holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    at = lambda k: F.min(F.when(holds(k), F.col(value)))
    picked, any_ = [], F.lit(False)
    for s in shares:
        place = s * (F.col("_total") - 1)
        picked += [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]
        any_ = any_ | holds(F.floor(place)) | holds(F.ceil(place))
    g = c.where(any_).groupBy(*by).agg(*(x.alias(f"_p{k}") for k, x in enumerate(picked)))
    between = [F.col(f"_p{k}") + F.col(f"_p{k + 2}") * (F.col(f"_p{k + 1}") - F.col(f"_p{k}")) for k in range(0, len(picked), 3)]
    return g.select(*by, F.array(*between).alias("q"))
