"""Nested cascades: counts and money of every rung in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, rungs: list[tuple[str, Column]], amount: str | None = None, variants: dict[str, Column] | None = None) -> DataFrame:
    """(rung, step, variant, n, total): rows that meet a rung and all before it, and their
    amount, for each variant of the rows (all of them unless named). One aggregate over the
    rows, then one row for each cell."""
    variants = variants or {"all": F.lit(True)}
    cells, holds = [], F.lit(True)
    for k, (name, condition) in enumerate(rungs):
        holds = holds & F.coalesce(condition, F.lit(False))
        for v, chosen in variants.items():
            both = holds & F.coalesce(chosen, F.lit(False))
            total = F.sum(F.when(both, F.col(amount))).cast("double") if amount else F.lit(None).cast("double")
            cells.append(F.struct(F.lit(k).alias("rung"), F.lit(name).alias("step"), F.lit(v).alias("variant"), F.count_if(both).alias("n"), total.alias("total")))
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def rates_under_lists(rows: DataFrame, flag: Column, lists: dict[str, Column]) -> DataFrame:
    """(list, n, n_flag, pct): the share of flagged rows among those that each list keeps."""
    cells = []
    for name, kept in lists.items():
        k = F.coalesce(kept, F.lit(False))
        cells.append(F.struct(F.lit(name).alias("list"), F.count_if(k).alias("n"), F.count_if(k & flag).alias("n_flag")))
    out = rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return out.withColumn("pct", F.round(F.try_divide(100.0 * F.col("n_flag"), F.col("n")), 6))


def grouping_cascade(rows: DataFrame, by: list[str], rungs: list[tuple[str, Column]]) -> DataFrame:
    """Rung counts at every grouping of the two keys: both, each alone, and none; ``level``
    tells which (a NULL key is not the NULL of a total)."""
    a, b = by
    holds, counts = F.lit(True), {}
    for name, condition in rungs:
        holds = holds & F.coalesce(condition, F.lit(False))
        counts[name] = holds.cast("int")
    # the finest cells first: only they are expanded to the other groupings
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in counts.items()))
    g = cells.groupingSets([[a, b], [a], [b], []], a, b).agg(F.grouping_id().alias("_g"), F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in counts))
    level = F.when(F.col("_g") == 0, "both").when(F.col("_g") == 1, a).when(F.col("_g") == 2, b).otherwise("total")
    return g.withColumn("level", level).withColumn("n", F.coalesce("n", F.lit(0))).drop("_g")
