"""Agreement of the code sets that two sides of a process declare for the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import order_digest, prefixes, valid_code
from .ranks import digest_rank

# fixed values: buckets by the size of the declared set
CARDINALITY = [(1, "01_single"), (2, "02_two"), (5, "03_3_to_5"), (10, "04_6_to_10"), (20, "05_11_to_20")]


def profile(rows: DataFrame, key: str, code: str, amount: str | None = None, side: str = "a") -> DataFrame:
    """Per key: rows, the sorted set of valid codes, and the amount."""
    more = [F.sum(amount).alias(f"amount_{side}")] if amount else []
    return rows.groupBy(key).agg(F.count("*").alias(f"n_{side}"), F.sort_array(F.collect_set(valid_code(F.col(code)))).alias(f"codes_{side}"), *more)


def universe(a: Column, b: Column, lines: Column) -> Column:
    """A: one code on either side and one line; B: one code on either side, several lines;
    C: several codes and both sides known; D, E: a side has none."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "E")
        .when((F.size(a) == 0) | (F.size(b) == 0), "D")
        .when((F.size(a) == 1) & (F.size(b) == 1) & (lines == 1), "A")
        .when((F.size(a) == 1) & (F.size(b) == 1), "B")
        .otherwise("C")
    )


def size_bucket(codes: Column) -> Column:
    out = F.when(F.size(codes) == 0, "00_none")
    for top, label in CARDINALITY:
        out = out.when(F.size(codes) <= top, label)
    return out.otherwise("06_over_20")


def paired(declared: DataFrame, realised: DataFrame, key: str) -> DataFrame:
    """Both profiles of each key that both sides have, with its universe and bucket. Each
    side is reduced to the key before the join, which is then one to one."""
    both = declared.join(realised, key)
    return both.withColumn("universe", universe(F.col("codes_a"), F.col("codes_b"), F.col("n_b"))).withColumn("bucket", size_bucket(F.col("codes_a")))


def agreement(pairs: DataFrame, by: list[str], digits: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Per group and number of digits: pairs, and the shares (per cent) of overlap, of
    realised within declared, of equality, and the mean Jaccard index."""
    a, b = F.col("codes_a"), F.col("codes_b")
    known = pairs.where((F.size(a) > 0) & (F.size(b) > 0))
    level = F.explode(F.array(*(F.struct(F.lit(d).alias("digits"), prefixes(a, d).alias("a"), prefixes(b, d).alias("b")) for d in digits)))
    rows = known.select(*by, level.alias("x")).select(*by, "x.*")
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return rows.groupBy(*by, "digits").agg(
        F.count("*").alias("n"), share(both > 0).alias("overlap_pct"), share(F.size(F.array_except("b", "a")) == 0).alias("subset_pct"),
        share((F.size(F.array_except("b", "a")) == 0) & (F.size(F.array_except("a", "b")) == 0)).alias("equal_pct"), F.round(F.avg(F.try_divide(both, either)), 6).alias("jaccard"),
    )


def permuted(pairs: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """The null: declared sets against the realised sets of other keys of the stratum, by two
    independent orders. ``self_pair`` tells where a key met itself."""
    one = digest_rank(pairs.withColumn("_d", order_digest(F.col(key), seed)), strata, "_d", "_i", [key])
    two = digest_rank(pairs.withColumn("_d", order_digest(F.col(key), seed + 7)), strata, "_d", "_i", [key])
    left = one.select(*strata, "_i", F.col(key), "codes_a")
    right = two.select(*strata, "_i", F.col(key).alias("_other"), "codes_b")
    return left.join(right, [*strata, "_i"]).withColumn("self_pair", F.col(key) == F.col("_other")).drop("_i")


def gap(real: DataFrame, null: DataFrame, by: list[str], rate: str, threshold: float) -> DataFrame:
    """Real minus null, weighted by the size of the groups, with the check that both have
    the same n in every group and the verdict against a threshold (points)."""
    keys = [*by, "digits"]
    both = real.select(*keys, F.col("n").alias("n_real"), F.col(rate).alias("r")).join(null.select(*keys, F.col("n").alias("n_null"), F.col(rate).alias("z")), keys)
    s = both.groupBy("digits").agg(
        F.sum("n_real").alias("n"), F.round(F.sum(F.col("r") * F.col("n_real")) / F.sum("n_real"), 6).alias("real_pct"), F.round(F.sum(F.col("z") * F.col("n_null")) / F.sum("n_null"), 6).alias("null_pct"),
        F.bool_and(F.col("n_real") == F.col("n_null")).alias("equal_n"),
    )
    return s.withColumn("gap", F.round(F.col("real_pct") - F.col("null_pct"), 6)).withColumn("above_null", F.col("gap") >= threshold)


def weighted_coverage(lines: DataFrame, declared: DataFrame, key: str, code: str, amount: str, digits: int = 4) -> DataFrame:
    """One row: the share of lines and of money whose code prefix the key declares."""
    sets = declared.where(F.size("codes_a") > 0).select(key, prefixes(F.col("codes_a"), digits).alias("_set"))
    c = valid_code(F.col(code))
    rows = lines.where(c.isNotNull()).join(sets, key)
    inside = F.array_contains("_set", F.substring(c, 1, digits))
    s = rows.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), F.sum(amount).alias("m"), F.sum(F.when(inside, F.col(amount))).alias("m_in"))
    pct = lambda a, b: F.round(100 * F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return s.select("n", "n_inside", pct("n_inside", "n").alias("line_pct"), pct("m_in", "m").alias("money_pct"))


def match_depth(a: Column, b: Column, digits: tuple[int, ...] = (8, 6, 4, 2)) -> Column:
    """The most digits at which two sets share a code (0 for none)."""
    out = F.when(F.lit(False), F.lit(0))
    for d in digits:
        out = out.when(F.size(F.array_intersect(prefixes(a, d), prefixes(b, d))) > 0, d)
    return out.otherwise(0)
