"""Money: native currency, capture errors, reconciliation, concentration, dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import percent
from ..sources.sinks import settled
from .ranks import quantiles


def deflate(rows: DataFrame, index: DataFrame, date: str, amount: str, y: str = "y", m: str = "m", idx: str = "idx") -> DataFrame:
    """rows with price_index and real_amount, in money of the index's highest value; months
    without an index keep the nominal amount. The index has one row a month."""
    top = F.max(idx).over(Window.partitionBy())
    known = index.select(F.col(y).alias("_y"), F.col(m).alias("_m"), F.col(idx).alias("price_index"), top.alias("_top"))
    out = rows.join(F.broadcast(known), (F.year(date) == F.col("_y")) & (F.month(date) == F.col("_m")), "left")
    return out.withColumn("real_amount", F.coalesce(F.col(amount) * F.col("_top") / F.col("price_index"), F.col(amount))).drop("_y", "_m", "_top")


def native(amount: Column, currency: Column, home: str = "CLP") -> Column:
    """The amount where it is in the home currency; foreign ones are never added to it."""
    return F.when(F.upper(F.trim(currency)) == home, amount)


def capture_error(price: Column, quantity: Column, above: float = 1000) -> Column:
    """The signature of a price typed as a quantity, or the other way round."""
    return F.coalesce((price == quantity) & (price > above), F.lit(False))


def linked_money_by_start(rows: DataFrame, year: str, starts: list[int], currency: str, amount: str, linked: Column) -> DataFrame:
    """Per start year and currency: money from then on, and the linked part of it."""
    later = rows.select(currency, amount, linked.alias("_l"), F.explode(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col(year))).alias("start"))
    g = later.groupBy("start", currency).agg(F.sum(amount).alias("m"), F.sum(F.when(F.col("_l"), F.col(amount))).alias("l"))
    return g.select("start", currency, F.col("m").cast("double").alias("total"), F.col("l").cast("double").alias("linked_total"), F.round(percent(F.col("l").cast("double"), F.col("m").cast("double")), 6).alias("pct"))


def reconcile_documents(rows: DataFrame, doc: str, amount: str, declared: str, tolerance: float = 0.01, *, more: tuple[Column, ...] = ()) -> DataFrame:
    """Per document: the sum of its lines against its declared total, and whether the ratio
    lies outside the tolerance. The declared total is the largest, where lines disagree.
    ``more`` are aggregates of the lines made in the same pass."""
    d = rows.groupBy(doc).agg(F.sum(amount).cast("double").alias("lines_total"), F.max(declared).cast("double").alias("doc_total"), *more)
    return d.withColumn("ratio", F.try_divide("lines_total", "doc_total")).withColumn("outside", F.abs(F.col("ratio") - 1) > tolerance)


def concentration(rows: DataFrame, code: str, measures: dict[str, Column], tops: tuple[int, ...] = (10, 50, 100, 300)) -> DataFrame:
    """(measure, ranked_by, top, share): the share of each measure that the N first codes
    hold, ranked by each measure. Rows are reduced to codes once; each ranking keeps its
    longest list only (every task its own first ones), and the totals are counted apart."""
    g = settled(rows.where(F.col(code).isNotNull()).groupBy(code).agg(*(F.sum(c).cast("double").alias(m) for m, c in measures.items())))
    names, frames = list(measures), None
    totals = g.agg(*(F.sum(m).alias(f"_{m}") for m in names))
    for by in names:
        first = g.where(F.col(by).isNotNull()).orderBy(F.desc(by), code).limit(max(tops))
        # one row: the longest list, in order
        first = first.agg(F.sort_array(F.collect_list(F.struct((-F.col(by)).alias("_by"), F.col(code).alias("_code"), *names))).alias("_list"))

        def held(m, n):
            some = F.filter(F.transform(F.slice("_list", 1, n), lambda x: x[m]), lambda x: x.isNotNull())
            return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x))

        cells = [F.struct(F.lit(m).alias("measure"), F.lit(by).alias("ranked_by"), F.lit(n).alias("top"), F.round(percent(held(m, n), F.col(f"_{m}")), 6).alias("share")) for m in names for n in tops]
        one = first.join(totals).select(F.inline(F.array(*cells)))
        frames = one if frames is None else frames.unionByName(one)
    return frames


def dispersion(rows: DataFrame, by: list[str], price: str, entity: str, least_rows: int = 100, least_entities: int = 5, least_price: float = 0) -> DataFrame:
    """Per cell with enough rows and entities: price quantiles and their ratios."""
    rows = rows.where(F.col(price) >= least_price)
    q = rows.groupBy(*by, entity).agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.count(entity).alias("n_entities"))
    enough = q.where((F.col("n") >= least_rows) & (F.col("n_entities") >= least_entities))
    at = quantiles(rows, by, price, [0.1, 0.25, 0.5, 0.75, 0.9]).toDF(*(f"_{c}" for c in by), "q")
    same = F.lit(True)
    for c in by:  # a NULL cell is a cell
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    q = enough.join(at, same)
    r = lambda a, b: F.round(F.try_divide(F.col("q")[a], F.col("q")[b]), 6)
    return q.select(*by, "n", "n_entities", F.round(F.col("q")[2], 4).alias("median"), r(3, 1).alias("p75_p25"), r(4, 0).alias("p90_p10"))


def dominant_label(rows: DataFrame, code: str, label: str, weak_under: float = 60.0) -> DataFrame:
    """Per code: its most frequent label, that label's share, the runner-up, and whether the
    share is weak. Ties go to the first label by name."""
    n = rows.where(F.col(code).isNotNull() & F.col(label).isNotNull()).groupBy(code, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(code)
    r = n.withColumn("rk", F.row_number().over(w.orderBy(F.desc("n"), label))).withColumn("all", F.sum("n").over(w)).where("rk <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rk") == k, F.col(c)))
    g = r.groupBy(code).agg(pick(1, label).alias("dominant"), pick(2, label).alias("runner_up"), F.max("all").alias("n"), F.round(percent(pick(1, "n"), F.max("all")), 6).alias("share"))
    return g.withColumn("weak", F.col("share") < weak_under)
