"""Reproducible samples with design weights, and estimates from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import order_digest
from .ranks import first_per_group

#: Width of the digest prefix that is read as a number in [0, 1).
_HEX = 13


def hash_share(digest: Column) -> Column:
    """The digest's first digits as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") / float(16**_HEX)


def bottom_k(rows: DataFrame, strata: list[str], digest: str, total: int, tie: list[str]) -> DataFrame:
    """About ``total`` rows: of each stratum the q = max(1, round(total / strata)) smallest
    digests, and of those the ``total`` smallest. Ties go by the given columns."""
    n = rows.select(*strata).distinct().count()
    q = max(1, int(total / n + 0.5)) if n else 1
    order = [F.asc(digest), *map(F.asc_nulls_first, tie)]
    return first_per_group(rows, strata, order, q).orderBy(*order).limit(total)


def stratum_sizes(rows: DataFrame, strata: list[str], content: str, amount: str) -> DataFrame:
    """Per stratum: rows, distinct contents, money."""
    d = rows.groupBy(*strata, content).agg(F.count("*").alias("n"), F.sum(amount).alias("a"))
    return d.groupBy(*strata).agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_contents"), F.sum("a").cast("double").alias("total"))


def inclusion(weights: DataFrame, size: str, threshold: float) -> DataFrame:
    """Inclusion probability of a stratum of n contents when its smallest digest lies under
    a threshold: pi = 1 - (1 - t)^n; and its inverse as design weight."""
    pi = 1 - F.pow(F.lit(1 - threshold), F.col(size))
    return weights.withColumn("pi", pi).withColumn("weight", F.try_divide(F.lit(1.0), F.col("pi")))


def design_fit(weights: DataFrame, selected: int) -> DataFrame:
    """One row: expected number of selected strata, its standard deviation, and the z of
    what was selected: where every stratum is certain, infinite, or NaN if all fits."""
    g = weights.agg(F.sum("pi").alias("e"), F.sqrt(F.sum(F.col("pi") * (1 - F.col("pi")))).alias("sd"))
    off = selected - F.col("e")
    z = F.when(F.col("sd") == 0, F.when(off > 0, float("inf")).when(off < 0, float("-inf")).otherwise(float("nan"))).otherwise(F.try_divide(off, "sd"))
    return g.select(F.round("e", 6).alias("expected"), F.round("sd", 6).alias("sd"), F.lit(selected).cast("long").alias("selected"), F.round(z, 6).alias("z"))


def coverage_by_band(weights: DataFrame, size: str, limits: list[float]) -> DataFrame:
    """Strata and their lines by band of inclusion probability."""
    band = F.when(F.lit(False), F.lit(0))
    for k, top in enumerate(limits):
        band = band.when(F.col("pi") <= top, k)
    return weights.groupBy(band.otherwise(len(limits)).alias("band")).agg(F.count("*").alias("n_strata"), F.sum(size).alias("n_lines"))


def kish(rows: DataFrame, weight: str, top: int = 5) -> DataFrame:
    """One row: rows, effective sample size, and the share of the largest weights."""
    g = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("s"), F.sum(F.col(weight) * F.col(weight)).alias("s2"))
    best = rows.orderBy(F.desc(weight)).limit(top).agg(F.sum(weight).alias("b"))
    return g.join(best).select("n", F.round(F.try_divide(F.col("s") * F.col("s"), F.col("s2")), 6).alias("n_effective"), F.round(100 * F.try_divide("b", "s"), 6).alias("top_pct"))


def weighted_estimate(rows: DataFrame, value: Column, weight: str) -> DataFrame:
    """One row: the weighted share (per cent) of a condition."""
    v = F.coalesce(value, F.lit(False)).cast("int")
    return rows.agg(F.count("*").alias("n"), F.round(100 * F.try_divide(F.sum(v * F.col(weight)), F.sum(weight)), 6).alias("estimate"))


def bootstrap(rows: DataFrame, key: str, value: Column, weight: str, replicates: int = 4000, seed: int = 1) -> DataFrame:
    """One row: the weighted share and its 95 % percentile interval. Every row draws a
    Poisson(1) count in every replicate from a digest of its key, so a replicate needs no
    resampling shuffle. A task adds all replicates of its rows into one array, so what
    travels is a pair of sums for each replicate and task, however many rows there are."""
    # Poisson(1): cumulative probabilities of 0 to 7
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    v = F.coalesce(value, F.lit(False)).cast("int")

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        edges, tails = np.array(steps), [f"{b}|{seed}".encode() for b in range(replicates)]
        a, t = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            for key_, w, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w is None:
                    continue
                start = hashlib.md5(b"" if key_ is None else key_.encode() + b"|")
                draws = np.empty(replicates)
                for b, tail in enumerate(tails):
                    h = start.copy()
                    h.update(tail)
                    draws[b] = int.from_bytes(h.digest()[:7]) >> 4
                n = np.searchsorted(edges, draws / float(1 << 52), side="right") * w
                t += n
                a += n * y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(a), pa.array(t)], ["b", "a", "t"])

    fed = rows.select(F.col(key).cast("string"), F.col(weight).cast("double"), v.cast("double"))
    g = fed.mapInArrow(partial, "b long, a double, t double").groupBy("b").agg(F.sum("a").alias("a"), F.sum("t").alias("t"))
    q = g.select(F.try_divide(100 * F.col("a"), F.col("t")).alias("e")).agg(F.percentile("e", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = rows.agg(F.count("*").alias("n"), F.try_divide(100 * F.sum(v * F.col(weight)), F.sum(weight)).alias("estimate"))
    return point.join(q).select("n", F.round("estimate", 6).alias("estimate"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def quota_groups(rows: DataFrame, rules: list[tuple[str, Column]], quotas: dict[str, int], key: str, order: list[Column]) -> DataFrame:
    """Rows by the first rule they meet (and the names of all), at most a quota of each."""
    first, every = F.when(F.lit(False), F.lit("")), []
    for name, c in rules:
        hit = F.coalesce(c, F.lit(False))
        first = first.when(hit, name)
        every.append(F.when(hit, F.lit(name)))
    named = rows.withColumn("group", first).withColumn("all_groups", F.concat_ws("+", *every)).where("group is not null")
    quota = F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))
    return first_per_group(named, ["group"], order, max(quotas.values()), "rk").where(F.col("rk") <= quota[F.col("group")]).drop("rk")


def quota_shortfall(chosen: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Per group: the quota, how many were found, and what is missing."""
    spark = chosen.sparkSession
    wanted = spark.createDataFrame(list(quotas.items()), "group string, quota int")
    return wanted.join(chosen.groupBy("group").agg(F.count("*").alias("n")), "group", "left").fillna(0, ["n"]).withColumn("missing", F.col("quota") - F.col("n"))


def row_budget(rows: DataFrame, key: str, budget: int, seed: int = 7) -> DataFrame:
    """About ``budget`` rows: those whose digest lies under budget / rows. The size is that of
    the rows given, so reduce them before."""
    n = rows.count()
    if n <= budget:
        return rows
    return rows.where(hash_share(order_digest(F.col(key), seed)) < budget / n)


def blind(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the columns that a judge may see."""
    return rows.select(*[c for c in allowed if c in rows.columns])
