"""Columns by alias: names that changed between years mean the same field."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]", "", plain)


def resolve(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that a column equals, by normalised name."""
    by = {}
    for c in columns:
        by.setdefault(normal_name(c), c)
    return next((by[normal_name(a)] for a in aliases if normal_name(a) in by), None)


def resolve_loosely(columns: list[str], aliases: list[str]) -> tuple[str | None, str | None]:
    """(column, warning): exact first; else the only column that contains an alias, with a
    warning that says so. Several such columns resolve to none."""
    exact = resolve(columns, aliases)
    if exact is not None:
        return exact, None
    for a in aliases:
        part = [c for c in columns if normal_name(a) in normal_name(c)]
        if len(part) == 1:
            return part[0], f"{a!r} matched {part[0]!r} in part only"
        if part:
            return None, f"{a!r} matches {len(part)} columns in part"
    return None, f"none of {aliases!r} found"


def resolution(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(field, column, warning, n_filled): the column that each field resolves to, exactly or
    in part, what has to be announced of it, and its values that are not NULL."""
    out = []
    for field, aliases in fields.items():
        column, warning = resolve_loosely(rows.columns, aliases)
        filled = F.count(F.col(f"`{column}`")) if column else F.lit(None).cast("long")
        out.append(F.struct(F.lit(field).alias("field"), F.lit(column).cast("string").alias("column"), F.lit(warning).cast("string").alias("warning"), filled.alias("n_filled")))
    return rows.agg(F.array(*out).alias("r")).select(F.inline("r"))


def canonical(rows: DataFrame, fields: dict[str, list[str]], prefix: str = "_unmapped_") -> DataFrame:
    """Aliased columns under their canonical names, the rest with a prefix."""
    found = {resolve(rows.columns, a): f for f, a in fields.items()}
    return rows.toDF(*(found.get(c, prefix + c) for c in rows.columns))


def against_target(rows: DataFrame, target: dict[str, str], fill_missing: bool = False, drop_extra: bool = False) -> DataFrame:
    """The target's columns, in order and type. Missing and extra ones need an explicit
    decision; without it they are an error."""
    missing, extra = [c for c in target if c not in rows.columns], [c for c in rows.columns if c not in target]
    if missing and not fill_missing or extra and not drop_extra:
        raise ValueError(f"missing {missing}, extra {extra}: decide with fill_missing and drop_extra")
    return rows.select(*((F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in target.items()))


def either(first: Column, second: Column) -> Column:
    """The first column where it is filled, else the second."""
    blank = F.coalesce(F.trim(first.cast("string")) == "", F.lit(True))
    return F.when(blank, second).otherwise(first)
