"""Whether free text can support a code: evaluable texts, leakage guards, label funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import percent

# fixed values: patterns of text that says nothing about the thing bought
FILLER = [
    "^segun bases", "^ver bases", "^de acuerdo a bases", "^segun adjudicacion", "^segun licitacion", "^segun oferta", "^segun contrato", "^segun convenio", "^segun cotizacion", "^segun solicitud", "^segun oc", "^segun detalle",
    "^ver detalle", "^ver anexo", "^ver adjunto", "^s ?/ ?e$", "^sin especificacion", "^no aplica$", "^na$", "^n a$", "^varios$", "^otros$", "^servicio$", "^servicios$", "^producto$", "^productos$", "^item$", "^items$", "^bienes$",
    "^-+$", "^\\.+$", "^0+$", "^x+$",
]


def is_filler(text: Column, least: int = 12, patterns: list[str] = FILLER) -> Column:
    """Too short, or boilerplate (texts are normalised; NULL is filler). Patterns of the
    beginning share one anchor, so a long text is left after its first characters."""
    start, other = [p[1:] for p in patterns if p.startswith("^")], [p for p in patterns if not p.startswith("^")]
    found = text.rlike("|".join(([rf"\A(?:{'|'.join(start)})"] if start else []) + other))
    return F.coalesce((F.length(text) < least) | found, F.lit(True))


def is_circular(text: Column, name: Column) -> Column:
    """Whether a text equals, contains or is contained in the name that it should support."""
    return F.coalesce(text.contains(name) | name.contains(text), F.lit(False))


def evaluable(text: Column, name: Column, least: int = 12, patterns: list[str] = FILLER) -> Column:
    return text.isNotNull() & ~is_filler(text, least, patterns) & ~is_circular(text, name)


def code_written(text: Column, code: Column, digits: tuple[int, ...] = (8, 6, 4)) -> Column:
    """Whether the text spells the code or one of its prefixes."""
    out = F.lit(False)
    for d in digits:
        out = out | text.contains(F.substring(code, 1, d))
    return F.coalesce(out, F.lit(False))


def trainable(text: Column, code: Column, name: Column, least_tokens: int = 1) -> dict[str, Column]:
    """The guards of a training text, in order."""
    return {
        "not_circular": ~is_circular(text, name),
        "code_not_written": ~code_written(text, code),
        "not_filler": ~is_filler(text),
        "enough_tokens": F.size(F.split(text, " ")) >= least_tokens,
    }


def frequent_texts(rows: DataFrame, text: str, k: int = 40) -> DataFrame:
    """The k most repeated texts, and whether the filler rule already catches them."""
    g = rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), text).limit(k).withColumn("caught", is_filler(F.col(text)))


def distinct_pairs(rows: DataFrame, text: str, code: str, rsd: float = 0.02) -> DataFrame:
    """One row: rows, distinct (text, code) pairs exact and approximate, and the factor."""
    pair = rows.where(F.col(text).isNotNull() & F.col(code).isNotNull()).select(F.xxhash64(text, code).alias("p"), F.sha2(text, 256).alias("digest"), code)
    # a sketch of the groups is one of the rows, and the text decides p
    found = pair.groupBy("digest", code, "p").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_pairs"), F.approx_count_distinct("p", rsd).alias("approx_pairs"))
    return found.withColumn("factor", F.round(F.try_divide("n_rows", "n_pairs"), 6))


def dedup_texts(rows: DataFrame, text: str, label: Column, keep: list[str]) -> DataFrame:
    """One row a text that has one label only: the label, the repeat count, least values of
    the kept columns. Ambiguous texts go. Groups are those of the text's SHA-256, so texts
    travel only where they are read afterwards."""
    g = rows.where(F.col(text).isNotNull()).withColumn("_label", label).where("_label is not null").groupBy(F.sha2(text, 256).alias("_digest"))
    out = g.agg(F.min(text).alias(text), F.min("_label").alias("label"), F.max("_label").alias("_other"), F.count("*").alias("n_repeats"), *(F.min(c).alias(c) for c in keep))
    return out.where("label = _other").drop("_other", "_digest")


def circularity(rows: DataFrame, year: str, group: str, circular: Column) -> DataFrame:
    """Per year and group: rows, circular share, and the group's weight in the year."""
    from pyspark.sql import Window

    g = rows.groupBy(year, group).agg(F.count("*").alias("n"), F.count_if(circular).alias("k"))
    return g.select(year, group, "n", F.round(percent(F.col("k"), F.col("n")), 6).alias("circular_pct"), F.round(percent(F.col("n"), F.sum("n").over(Window.partitionBy(year))), 6).alias("weight_pct"))
