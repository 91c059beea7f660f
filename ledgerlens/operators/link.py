"""Links between tables that keep cardinality, and the rates that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import filled, norm_key, percent


def link(lines: DataFrame, keys: DataFrame, line_key: str, key: str, flag: str = "linked") -> DataFrame:
    """Every line, with whether its key is among the keys. Keys are made distinct first, so
    no line is repeated; blank and NULL keys link to nothing. A frequent key is split by
    the adaptive join, as only the flag is joined to it."""
    there = keys.select(norm_key(F.col(key)).alias("_there")).where("_there is not null").distinct()
    return lines.join(there, norm_key(F.col(line_key)) == F.col("_there"), "left").withColumn(flag, F.col("_there").isNotNull()).drop("_there")


def cardinality_kept(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the rows before and after a join, and whether they are as many."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(before, "n_before").join(n(after, "n_after")).withColumn("kept", F.col("n_before") == F.col("n_after"))


def by_key_presence(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable key, and all others (NULL ones included)."""
    has = F.coalesce(filled(F.col(key)), F.lit(False))
    return rows.where(has), rows.where(~has)


def not_excluded(group: Column, excluded: list[str], null_counts: bool = False) -> Column:
    """Whether a group is off the list, with a declared answer for NULL."""
    return F.coalesce(~group.isin(excluded), F.lit(null_counts)) if excluded else F.lit(True)


def coverage(rows: DataFrame, group: str, flag: Column) -> DataFrame:
    """Per group: rows, rows with the flag, their share in per cent."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_flag"))
    return g.withColumn("pct", F.round(percent(F.col("n_flag"), F.col("n")), 6))


def structural_groups(covered: DataFrame, group: str, under: float = 5.0) -> DataFrame:
    """The groups so seldom flagged that they cannot be (a class list taken from data)."""
    return covered.where(F.col("pct") < under).select(group)


def link_rates(linked: DataFrame, key: str, doc: str, group: str, structural: DataFrame, flag: str = "linked") -> DataFrame:
    """One row: the share of linked lines among all, among keyed ones, among those outside
    structural groups; and of documents with a linked line. Documents are reduced first, so
    distinct counts do not multiply the lines."""
    marked = linked.join(structural.withColumn("_s", F.lit(True)), group, "left")
    has, on, usual = F.coalesce(filled(F.col(key)), F.lit(False)), F.col(flag), F.col("_s").isNull()
    docs = marked.groupBy(doc).agg(
        F.count("*").alias("n"), F.count_if(on).alias("l"), F.count_if(has).alias("k"), F.count_if(usual).alias("u"), F.count_if(usual & on).alias("ul")
    )
    s = docs.agg(*(F.sum(c).alias(c) for c in ("n", "l", "k", "u", "ul")), F.count("*").alias("docs"), F.count_if(F.col("l") > 0).alias("linked_docs"))
    rate = lambda a, b: F.round(percent(F.col(a), F.col(b)), 6)
    return s.select(
        F.col("n").alias("n_lines"), F.col("docs").alias("n_docs"), rate("l", "n").alias("line_rate"), rate("l", "k").alias("keyed_rate"), rate("ul", "u").alias("usual_rate"), rate("linked_docs", "docs").alias("doc_rate")
    )


def grain(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, rows per key, the largest key."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count(key).alias("n_keys"), F.max("n").alias("most")).withColumn("rows_per_key", F.round(F.try_divide("n_rows", "n_keys"), 6))


def adjusted_link_rate(rows: DataFrame, flag: Column, key_year: Column, first_year: int) -> DataFrame:
    """One row: the link rate, and the rate without the unlinked keys that point before the
    first year loaded."""
    before = ~flag & F.coalesce(key_year < first_year, F.lit(False))
    s = rows.agg(F.count("*").alias("n"), F.count_if(flag).alias("linked"), F.count_if(before).alias("before_universe"))
    return s.withColumn("rate", F.round(percent(F.col("linked"), F.col("n")), 6)).withColumn("adjusted_rate", F.round(percent(F.col("linked"), F.col("n") - F.col("before_universe")), 6))


def flagged_keys(rows: DataFrame, key: str, condition: Column, flag: str) -> DataFrame:
    """rows with whether any row of their key meets the condition."""
    good = rows.where(condition).select(F.col(key).alias("_k")).distinct().withColumn("_f", F.lit(True))
    return rows.join(good, F.col(key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_f", F.lit(False))).drop("_k", "_f")


def key_differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side): only_old, only_new or common, over distinct keys."""
    a = old.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = new.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "only_old").when(F.col("_a").isNull(), "only_new").otherwise("common")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def same_selection(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """One row: how many ids only one of two selections has, and whether they are equal."""
    d = key_differences(one, other, key).agg(F.count_if(F.col("side") == "only_old").alias("only_first"), F.count_if(F.col("side") == "only_new").alias("only_second"), F.count_if(F.col("side") == "common").alias("common"))
    return d.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def counts_side_by_side(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Old and new counts of each period, their difference, and a mark where one lacks it."""
    a, b = old.groupBy(*on).agg(F.count("*").alias("n_old")), new.groupBy(*on).agg(F.count("*").alias("n_new"))
    both = a.join(b, on, "full_outer")
    mark = F.when(F.col("n_old").isNull(), "new_only").when(F.col("n_new").isNull(), "missing").when(F.col("n_new") < F.col("n_old"), "less").otherwise("ok")
    return both.withColumn("mark", mark).fillna(0, ["n_old", "n_new"]).withColumn("delta", F.col("n_new") - F.col("n_old"))


def watch(listed: DataFrame, rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Each listed key: whether it is there, its rows and the least value of each field. The
    list is short by contract; rows are reduced to its keys before anything else."""
    hits = rows.join(listed.select(key).distinct(), key, "left_semi")
    found = hits.groupBy(key).agg(F.count("*").alias("n_rows"), *(F.min(c).alias(n) for n, c in fields.items()))
    return listed.select(key).distinct().join(found, key, "left").withColumn("present", F.col("n_rows").isNotNull()).fillna(0, ["n_rows"])


def in_all(rows: DataFrame, entity: str, period: str, periods: list) -> DataFrame:
    """The rows, within the periods, of entities that have rows in every one of them."""
    within = rows.where(F.col(period).isin(periods))
    seen = within.select(entity, period).distinct().groupBy(entity).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(periods)))
    return within.join(seen.select(entity), entity, "left_semi")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def labelled_union(frames: dict[str, DataFrame], label: str = "series") -> DataFrame:
    return union_all([df.withColumn(label, F.lit(name)) for name, df in frames.items()])
