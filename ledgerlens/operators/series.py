"""Yearly series, panels, placebos, overflow and shift-share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import percent
from .link import in_all, labelled_union


def yearly(rows: DataFrame, year: str, rates: dict[str, Column], entity: str) -> DataFrame:
    """Per year: rows, entities, and the share (per cent) of each condition; a condition
    that is NULL counts as not met. Entities are counted on distinct pairs, beside."""
    g = rows.groupBy(year).agg(F.count("*").alias("n"), *(F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(k) for k, c in rates.items()))
    e = rows.select(year, entity).distinct().groupBy(year).agg(F.count(entity).alias("n_entities"))
    return g.join(e, year)


def panel(rows: DataFrame, year: str, years: list[int], rates: dict[str, Column], entity: str) -> DataFrame:
    """yearly over all rows and over the entities that have rows in every year."""
    return labelled_union({"full": yearly(rows, year, rates, entity), "balanced": yearly(in_all(rows, entity, year, years), year, rates, entity)})


def placebo_pairs(rows: DataFrame, year: str, pairs: list[tuple[int, int]], entity: str, condition: Column) -> DataFrame:
    """Per pair of years: the change of a rate among entities present in both. Rows are
    reduced to entity and year, then each pair takes the entities with both."""
    cell = rows.groupBy(entity, year).agg(F.count("*").alias("n"), F.count_if(condition).alias("k"))
    wanted = F.filter(F.array(*(F.struct(F.lit(a).alias("y0"), F.lit(b).alias("y1")) for a, b in pairs)), lambda p: (p["y0"] == F.col(year)) | (p["y1"] == F.col(year)))
    long = cell.select(entity, year, "n", "k", F.explode(wanted).alias("p")).select(entity, "n", "k", "p.*", (F.col(year) == F.col("p.y1")).alias("late"))
    both = long.groupBy("y0", "y1", entity).agg(
        *(F.sum(F.when(F.col("late") == late, F.col(c))).alias(f"{c}{int(late)}") for late in (False, True) for c in ("n", "k"))
    ).where("n0 is not null and n1 is not null")
    g = both.groupBy("y0", "y1").agg(F.count("*").alias("n_entities"), *(F.sum(c).alias(c) for c in ("n0", "k0", "n1", "k1")))
    before, after = percent(F.col("k0"), F.col("n0")), percent(F.col("k1"), F.col("n1"))
    return g.select("y0", "y1", "n_entities", F.round(before, 6).alias("before_pct"), F.round(after, 6).alias("after_pct"), F.round(after - before, 6).alias("delta"))


def overflow(rows: DataFrame, part: str, actual: str) -> DataFrame:
    """Per partition label and in all: rows whose own year is another one. NULL years count
    as unknown, not as overflow."""
    marked = rows.select(F.col(part).alias("part"), F.coalesce(F.col(part) != F.col(actual), F.lit(False)).alias("out"), F.col(actual).isNull().alias("unknown"))
    cells = marked.groupBy("part").agg(F.count("*").alias("n"), F.count_if("out").alias("n_out"), F.count_if("unknown").alias("n_unknown"))
    g = cells.groupingSets([["part"], []], "part").agg(F.grouping_id().alias("_g"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_out", "n_unknown")))
    label = F.when(F.col("_g") == 1, "all").otherwise(F.col("part").cast("string"))
    return g.select(label.alias("part"), "n", "n_out", "n_unknown", F.round(percent(F.col("n_out"), F.col("n")), 6).alias("pct"))


def shift_share(rows: DataFrame, year: str, group: str, condition: Column, y0: int, y1: int) -> DataFrame:
    """Per group and in all: how a rate's change splits into composition, behaviour and
    their interaction. All groups take part (NULL is one), so the parts add up."""
    cell = rows.where(F.col(year).isin(y0, y1)).groupBy(group).agg(
        *(F.count_if(F.col(year) == y).alias(f"n{k}") for k, y in enumerate((y0, y1))), *(F.count_if((F.col(year) == y) & condition).alias(f"k{k}") for k, y in enumerate((y0, y1)))
    )
    w = Window.partitionBy()
    for k in (0, 1):
        cell = cell.withColumn(f"w{k}", F.try_divide(100.0 * F.col(f"n{k}"), F.sum(f"n{k}").over(w))).withColumn(f"r{k}", F.coalesce(F.try_divide(F.col(f"k{k}"), F.col(f"n{k}")), F.lit(0.0)))
    dw, dr = F.col("w1") - F.col("w0"), F.col("r1") - F.col("r0")
    parts = cell.select(F.col(group).alias("member"), (dw * F.col("r0")).alias("composition"), (F.col("w0") * dr).alias("behaviour"), (dw * dr).alias("interaction"), (F.col("w1") * F.col("r1") - F.col("w0") * F.col("r0")).alias("total"))
    g = parts.groupingSets([["member"], []], "member").agg(F.grouping_id().alias("_g"), *(F.round(F.sum(c), 6).alias(c) for c in ("composition", "behaviour", "interaction", "total")))
    return g.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("member")).alias("member"), "composition", "behaviour", "interaction", "total")


def deficit(side_by_side: DataFrame, recent: Column, decline_pct: float = 2.0) -> DataFrame:
    """One row from monthly counts of two snapshots: the total deficit, missing months,
    declines beyond a share, months only in the new one, and the share of declines that
    fall in a recent window."""
    old, new = F.col("n_old"), F.col("n_new")
    fell = (old > 0) & (new > 0) & (100.0 * (old - new) > decline_pct * old)
    g = side_by_side.agg(
        F.sum(F.greatest(old - new, F.lit(0))).alias("deficit"), F.count_if((old > 0) & (new == 0)).alias("missing"), F.count_if(fell).alias("declines"),
        F.count_if((old == 0) & (new > 0)).alias("new_only"), F.count_if(fell & recent).alias("recent_declines"),
    )
    share = percent(F.col("recent_declines"), F.col("declines"))
    return g.withColumn("recent_pct", F.round(share, 6)).withColumn("localised", F.coalesce(share >= 60, F.lit(False)))
