"""Mixing sources to target weights by iterative proportional fitting, with DataFrame
functions only.

Documents fall into cells of source, language and topic. Each cell's token mass gets a
factor, and the factors are raked until the weighted mass meets the target shares of the
sources, of the languages and of the topics at once, or a bound on rounds is reached. A
cell's documents are then sampled with the factor as their probability, scaled by one
number for all cells: the budget, or less if probabilities would exceed one. The rarest cells
do not set that scale: those of the largest factors are taken whole, with probability one,
as long as all of them together have ``shortfall`` of the target mass at most. Expected shares are the
targets but for that, and ``residual`` says what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

DIMENSIONS = ["source", "lang", "topic"]


def tokens(text: Column) -> Column:
    """Words of the text: runs without ASCII white space (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from the text's form, by the first rule that holds."""
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(F.contains(F.lower(text), F.lit("license")), "legal")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit(" = ")), "code")
        .otherwise("prose")
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _summed(df: DataFrame, dim: str, value: Column, name: str, wide: bool) -> DataFrame:
    """df with the sum of value over the rows that share dim. Where df is wide (its rows
    were counted and are many) by partial sums and a join, which split a hot value over
    tasks; else by a window, which needs no second reading of a small table."""
    if not wide:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(dim)))
    sums = df.groupBy(F.col(dim).alias("v_")).agg(F.sum(value).alias(name))
    return cut(df.join(sums, _same(dim, "v_")).drop("v_"))


def tempered(cells: DataFrame, dim: str, alpha: float, wide: bool = False) -> DataFrame:
    """cells with t_<dim>, the target share of each value: its mass to the power alpha over
    their sum. Small values gain and large ones lose for alpha under one."""
    out = _summed(cells, dim, F.col("mass"), "all_", wide)
    power = F.pow("all_", alpha)
    total = out.agg(F.sum(power * F.col("mass") / F.col("all_"))).first()[0]
    return out.withColumn(f"t_{dim}", power / F.lit(total)).drop("all_")


def rake(cells: DataFrame, dims: list[str], total: float, rounds: int = 100, tolerance: float = 1e-11, wide: bool = False) -> DataFrame:
    """cells (mass > 0, and t_<dim>, the target share of the row's value) with factor: factors
    that make every weighted share its target, or come as close as they can where no factors
    do. It ends when a round moves ``tolerance`` of the mass at most, or after ``rounds``. The
    lineage is cut after each round where cells are many, else after four."""
    out = cells.withColumn("factor", F.lit(1.0))
    weighed = F.col("factor") * F.col("mass") / F.lit(total)
    every = 1 if wide else 4
    for k in range(rounds):
        out = out.withColumn("before", F.col("factor"))
        for d in dims:
            out = _summed(out, d, weighed, "now_", wide).withColumn("factor", F.col("factor") * F.col(f"t_{d}") / F.col("now_")).drop("now_")
        moved = F.abs(F.col("factor") - F.col("before")) * F.col("mass") / F.lit(total)
        out = out.withColumn("moved", moved).drop("before")
        if (k + 1) % every == 0 or k + 1 == rounds:
            out = cut(out)
            if (out.agg(F.sum("moved")).first()[0] or 0.0) <= tolerance:
                break
        out = out.drop("moved")
    return out.drop("moved")


def scale_of(raked: DataFrame, total: float, shortfall: float) -> float:
    """The scale at which the factors become probabilities: one over the largest factor, when
    those that have ``shortfall`` of the target mass at most are left out. Factors are
    counted in steps of a sixteenth of a power of two, so the driver meets some hundred rows."""
    step = F.floor(F.log2("factor") * 16)
    rows = raked.where("factor > 0").groupBy(step.alias("step")).agg(F.sum(F.col("factor") * F.col("mass") / F.lit(total)).alias("share"), F.max("factor").alias("most"))
    above = 0.0
    for row in sorted(rows.collect(), key=lambda r: -r.step):
        above += row.share
        if above > shortfall:
            return 1 / row.most
    return 1.0


def left_over(sampled: DataFrame, dims: list[str], wide: bool) -> DataFrame:
    """sampled (mass, prob) with residual: the largest distance that the expected shares of
    the row's values have from their targets."""
    kept = sampled.agg(F.sum(F.col("prob") * F.col("mass"))).first()[0] or 1.0
    out = sampled.withColumn("residual", F.lit(0.0))
    for d in dims:
        share = F.col("prob") * F.col("mass") / F.lit(kept)
        out = _summed(out, d, share, "now_", wide).withColumn("residual", F.greatest("residual", F.abs(F.col("now_") - F.col(f"t_{d}")))).drop("now_")
    return out


def fit(rows: DataFrame, columns: list[str], n_tokens: str, *, budget: float, alpha: float, rounds: int, targets: dict[str, DataFrame] | None = None, max_cells: int = 100_000, shortfall: float = 0.005) -> DataFrame | None:
    """One row for each cell that has tokens: c_source, c_lang, c_topic, prob, t_source,
    t_lang, t_topic, residual; broadcast if there are at most ``max_cells`` of these short
    rows. None where no row has a token."""
    cells = rows.where(F.col(n_tokens) > 0).groupBy(*(F.col(c).alias(d) for c, d in zip(columns, DIMENSIONS, strict=True))).agg(F.sum(n_tokens).cast("double").alias("mass"))
    cells = cut(cells)
    n, total = cells.agg(F.count("*"), F.sum("mass")).first()
    if not n:
        return None
    wide = n > max_cells
    if not wide:  # so few short rows fit one partition
        cells = cut(cells.coalesce(1))
    for d in DIMENSIONS:
        share = (targets or {}).get(d)
        if share is None:
            cells = tempered(cells, d, alpha, wide)
        else:
            cells = cells.join(share.select(F.col("value").alias("v_"), F.col("share").alias(f"t_{d}")), _same(d, "v_")).drop("v_")
    raked = rake(cut(cells), DIMENSIONS, total, rounds, wide=wide)
    scale = min(budget, scale_of(raked, total, shortfall))
    fitted = cut(left_over(raked.withColumn("prob", F.least(F.lit(1.0), scale * F.col("factor"))), DIMENSIONS, wide))
    out = fitted.select(*(F.col(d).alias(f"c_{d}") for d in DIMENSIONS), "prob", *(f"t_{d}" for d in DIMENSIONS), "residual")
    return out if wide else F.broadcast(out)


def uniform(key: Column, seed: int = 20) -> Column:
    """A number in [0, 1) from the key's digest, the same on every engine and run."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", *, topic_of: Column | None = None,
    budget: float = 1.0, alpha: float = 0.9, rounds: int = 100, targets: dict[str, DataFrame] | None = None, seed: int = 20, max_cells: int = 100_000, shortfall: float = 0.005,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, prob, u, sampled, t_source, t_lang, t_topic,
    residual) for every row.

    Targets (t_) are the tempered shares of each source, language and topic, or those of
    ``targets`` (dimension -> value, share; rows of a value without a share have prob 0).
    residual is the largest distance between target and expected share over the row's three
    values, ``shortfall`` the share of the target mass that cells taken whole may have.
    ``budget`` bounds the expected share of all tokens that is kept. A row is
    sampled where its uniform number u, a digest of its id, is under its cell's probability.
    Texts without words have no mass and are never sampled (prob 0; targets are null where
    their cell has no tokens). Null sources and languages are values like others, and so are
    null ids (which share one u). Rows that share an id and a cell are judged alike. Other
    columns do not matter; an empty table gives no rows. ``topic_of`` replaces the topic.
    """
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
            (topic(F.col(text_col)) if topic_of is None else topic_of).alias("topic"), tokens(F.col(text_col)).alias("n_tokens"),
        )
    )
    found = fit(rows, DIMENSIONS, "n_tokens", budget=budget, alpha=alpha, rounds=rounds, targets=targets, max_cells=max_cells, shortfall=shortfall)
    extra = ["prob", *(f"t_{d}" for d in DIMENSIONS), "residual"]
    if found is None:
        out = rows.withColumns({c: F.lit(None).cast("double") for c in extra})
    else:
        out = rows.join(found, _same("source", "c_source") & _same("lang", "c_lang") & _same("topic", "c_topic"), "left")
    out = out.withColumn("prob", F.when(F.col("n_tokens") > 0, F.coalesce("prob", F.lit(0.0))).otherwise(0.0)).withColumn("u", uniform(F.col("doc_id"), seed))
    return out.select("doc_id", *DIMENSIONS, "n_tokens", "prob", "u", (F.col("u") < F.col("prob")).alias("sampled"), *extra[1:])


def keep_sampled(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", *, topic_of: Column | None = None,
    budget: float = 1.0, alpha: float = 0.9, rounds: int = 100, targets: dict[str, DataFrame] | None = None, seed: int = 20, max_cells: int = 100_000, shortfall: float = 0.005,
) -> DataFrame:
    """The sampled rows, with the columns as they come. Rows and not ids are judged; texts do
    not travel where the cells are few."""
    names = []
    for c in (*DIMENSIONS, "n_tokens"):
        names.append(fresh(c + "_", docs.columns + names))
    made = [F.col(source_col).cast("string"), F.col(lang_col).cast("string"), topic(F.col(text_col)) if topic_of is None else topic_of, tokens(F.col(text_col))]
    rows = docs.withColumns(dict(zip(names, made, strict=True)))
    found = fit(rows, names[:3], names[3], budget=budget, alpha=alpha, rounds=rounds, targets=targets, max_cells=max_cells, shortfall=shortfall)
    if found is None:
        return docs.limit(0)
    prob = fresh("prob", docs.columns)
    cells = [fresh("c_" + d, docs.columns + names) for d in DIMENSIONS]
    small = found.select(*(F.col(f"c_{d}").alias(c) for d, c in zip(DIMENSIONS, cells, strict=True)), F.col("prob").alias(prob))
    same = _same(names[0], cells[0]) & _same(names[1], cells[1]) & _same(names[2], cells[2])
    return rows.join(small, same).where((F.col(names[3]) > 0) & (uniform(F.col(id_col).cast("long"), seed) < F.col(prob))).select(*docs.columns)
