"""Exact top-k search for binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, and an index maps (segment, value) to codes. A query
probes the segments with the values at distance 0, then 1, then 2, and so on. After radius
r in j of the m segments and r - 1 in the others, every code at a distance under m r + j has
been met, for one of its segments lies within the radius searched there. So a query ends
when its k-th best distance is under that bound: the result is exact, whatever the data.
A step of the search is one radius in all segments; the k-th distances are known before the
next, and only queries that are not covered yet go on. A pair is verified once, at the first
segment and radius that meet it, and is dropped there unless it can still be among the k best.
Segments are about as wide as the number of codes has bits, so a probe meets few codes
however many there are.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 64


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 numbers as the bits of a long (null and NaN: not positive); null
    for a null vector. A longer one is an error: it has to be projected first."""
    bits = F.transform(vector, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.expr("1L")).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector of more than {BITS} numbers"))).when(vector.isNotNull(), code)


def _segment(code: Column, j: int, width: int) -> Column:
    return F.shiftrightunsigned(code, j * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _masks(width: int, radius: int, low: bool) -> Column:
    """The lower or upper halves of all values of ``radius`` set bits, one list for each
    number of bits that fall into the lower half: 2^(width / 2) numbers at most, while the
    values that they make are many more and come to be in the tasks."""
    half = width // 2
    lists = []
    for below in range(max(0, radius - half), min(half, radius) + 1):
        n, shift = (below, 0) if low else (radius - below, half)
        lists.append(",".join(str(sum(1 << (b + shift) for b in bits)) for bits in combinations(range(half), n)))
    return F.transform(F.array(*map(F.lit, lists)), lambda x: F.split(x, ",").cast("array<long>"))


def _named(todo: DataFrame, segments: int, width: int, radius: int) -> DataFrame:
    """(q, kth, seg, val): the segment values at the distance ``radius``, counted out."""
    at = (F.struct(F.lit(j).alias("seg"), _segment(F.col("q"), j, width).alias("own")) for j in range(segments))
    probed = todo.select("q", "kth", F.explode(F.array(*at)).alias("s")).select("q", "kth", "s.seg", "s.own")
    halves = F.arrays_zip(_masks(width, radius, True).alias("low"), _masks(width, radius, False).alias("high"))
    probed = probed.select("*", F.explode(halves).alias("m")).select("q", "kth", "seg", "own", F.explode("m.low").alias("low"), F.col("m.high").alias("high"))
    probed = probed.select("q", "kth", "seg", F.col("own").bitwiseXOR(F.col("low")).alias("own"), F.explode("high").alias("high"))
    return probed.select("q", "kth", "seg", F.col("own").bitwiseXOR(F.col("high")).alias("val"))


def _listed(todo: DataFrame, values: DataFrame, segments: int, width: int, radius: int, blocks: int) -> DataFrame:
    """The same among the values that the index has: open queries meet them in blocks."""
    at = (F.struct(F.lit(j).alias("seg"), _segment(F.col("q"), j, width).alias("own")) for j in range(segments))
    asked = todo.select("q", "kth", F.explode(F.array(*at)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.select("q", "kth", F.col("s.seg").alias("seg"), F.col("s.own").alias("own"), "block")
    there = values.withColumn("block", F.pmod(F.xxhash64("val"), F.lit(blocks)).cast("int"))
    met = asked.join(there, ["seg", "block"]).where(F.bit_count(F.col("own").bitwiseXOR(F.col("val"))) == radius)
    return met.select("q", "kth", "seg", "val")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best codes of each query: no other can hold one of its k best rows."""
    w = Window.partitionBy("q").orderBy("distance", F.col("ids")[0])
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None, id_col: str = "id", code_col: str = "code", steps: list | None = None, per_block: int = 4096) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of codes nearest to each query, ties to
    the smaller id; fewer where codes has fewer rows. Both frames have id and code.

    Equal codes are searched once: of each distinct code the k smallest ids are kept, as
    no other of its rows can be among the k best. Rows without code or id are neither found
    nor asked for. Repeated rows are found as often as they are there. Other columns do not
    matter; of empty tables nothing is found. ``segments`` (2, 4 or 8) follows the number of
    distinct codes unless given. ``steps`` receives (radius, queries still open) of each step.
    A step lists the values at its radius, or, where these are more than the values that a
    segment of the index has, finds those among them, ``per_block`` at a time; so a query far
    from all codes costs a reading of the index's values for a radius at most.
    """
    if segments not in (None, 2, 4, 8):
        raise ValueError("2, 4 or 8 segments")
    rows = codes.select(F.col(id_col).alias("id"), F.col(code_col).cast("long").alias("code")).where("id is not null and code is not null")
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(code_col).cast("long").alias("q")).where("query_id is not null and q is not null")
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    lists = cut(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    if segments is None:
        size = lists.count().bit_length()
        segments = 8 if size <= 12 else 4 if size <= 24 else 2
    width = BITS // segments
    entry = lambda j: F.struct(F.lit(j).alias("seg"), _segment(F.col("code"), j, width).alias("val"))
    index = cut(lists.select("code", "ids", F.explode(F.array(*map(entry, range(segments)))).alias("s")).select("s.seg", "s.val", "code", "ids"))
    values = cut(index.select("seg", "val").distinct())
    held = values.groupBy("seg").count().agg(F.max("count")).first()[0] or 1
    asked = cut(asked)
    todo = cut(asked.select("q").distinct().withColumn("kth", F.lit(None).cast("int")))
    best = todo.limit(0).select("q", F.lit(0).alias("distance"), F.array(F.lit(0).cast(lists.schema["ids"].dataType.elementType)).alias("ids"))
    left = todo.count()
    for radius in range(width + 1):
        if not left:
            break
        if steps is not None:
            steps.append((radius, left))
        if comb(width, radius) <= held:
            probed = _named(todo, segments, width, radius)
        else:
            probed = _listed(todo, values, segments, width, radius, -(-held // per_block))
        probed = probed.withColumn("radius", F.lit(radius))
        gap = F.col("q").bitwiseXOR(F.col("code"))
        met = (probed["seg"] == index["seg"]) & (probed["val"] == index["val"]) & (F.bit_count(gap) <= F.coalesce("kth", F.lit(BITS)))
        # once only: no segment is nearer, and none before it is as near
        for j in range(segments):
            d = F.bit_count(_segment(gap, j, width))
            met = met & ((d > F.col("radius")) | ((d == F.col("radius")) & (probed["seg"] <= j)))
        found = probed.join(index, met).select("q", F.bit_count(gap).alias("distance"), "ids")
        best = cut(_best(best.unionByName(found), k))
        seen = F.sum(F.size("ids")).over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0))
        kth = best.withColumn("seen", seen).where(F.col("seen") >= k).groupBy("q").agg(F.min("distance").alias("kth"))
        todo = cut(todo.select("q").join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") >= segments * (radius + 1))))
        left = todo.count()
    items = best.select("q", "distance", F.explode("ids").alias("id"))
    items = items.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return asked.join(items, "q").select("query_id", "rank", "id", "distance")
