"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Shards are leaves of a tree of racks and regions, and regions stand in zones, each as large as
all before it, so that the tree has room for any number of shards. A zone is cut at the
weights 1, 2, 4 and so on into cells, and each cell has a clock that strikes in proportion to
its room (its places times its height). At each strike the row's hash draws a region, a rack
and a shard of the zone and a height in the cell; the strike counts if the height is below
the shard's weight. A row belongs to the shard of its earliest strike that counts. So a
region, a rack and a shard are each won in proportion to their weights.

Clocks and draws depend on row, cell and number of the strike alone, never on weights or on
the count of shards. When a shard gains weight, strikes begin to count there and rows move
into it alone; when it loses weight only its own rows go elsewhere. Nothing moves within or
between subtrees whose weights stay, and a new shard takes rows only into itself. A row
hears some 1 + room / weight strikes over the cells in use: under four for equal weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, unit_hash

#: Strikes that are tried between two looks at whether a cell is done with.
CHUNK = 8


@dataclass(frozen=True)
class Tree:
    weights: tuple[float, ...]
    racks_per_region: int
    shards_per_rack: int

    def cells(self) -> list[tuple[int, int, float, float]]:
        """(first region, number of regions, least weight, most weight) of the cells in
        which a shard has weight, the largest room first."""
        per, first, n, found = self.racks_per_region * self.shards_per_rack, 0, 1, []
        while first * per < len(self.weights):
            most, low, high = max(self.weights[first * per : (first + n) * per]), 0.0, 1.0
            while low < most:
                found.append((first, n, low, high))
                low, high = high, 2 * high
            first, n = first + n, first + n
        return sorted(found, key=lambda c: -c[1] * (c[3] - c[2]))


def tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, weights: dict[int, float] | None = None) -> Tree:
    """The tree that a shard count stands for: racks fill up with shards, regions with racks.
    Shards weigh 1 unless ``weights`` has another number, of any size. A larger count has the
    same leaves in the same places, and more; other numbers of racks a region or shards a
    rack are another tree."""
    weight = tuple(float((weights or {}).get(s, 1.0)) for s in range(max(shards, 0)))
    if not all(0 <= w < math.inf for w in weight) or not sum(weight) or min(racks_per_region, shards_per_rack) < 1:
        raise ValueError("at least one shard is needed, with finite weights from 0 up, not all of them 0")
    return Tree(weight, racks_per_region, shards_per_rack)


def _with(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def pick(root: Tree, key: Column) -> Column:
    """The shard that a key belongs to. Null is a key. A row that hears no strike that counts
    in any cell (less than one in 10^17) goes to the first shard with a weight."""
    own = F.coalesce(key.cast("string"), F.lit("null key"))
    racks, leaves = root.racks_per_region, root.shards_per_rack
    weights = F.array(*map(F.lit, root.weights))
    cells, per = root.cells(), racks * leaves
    # the time that all but one row in 10^17 need is 40 / weight; strikes until then in the largest cell
    most = 40 * max(n * per * (high - low) for _, n, low, high in cells) / sum(root.weights)
    chunks = math.ceil((most + 10 * math.sqrt(most) + 40) / CHUNK)

    def strike(best: Column, cell: Column, run: Column, t: Column) -> Column:
        draw = lambda what, *more: unit_hash(own, t, cell["low"], F.lit(what), *more)
        index = lambda u, n: F.floor(u * n).cast("int")
        room = cell["regions"] * F.lit(float(per)) * (cell["high"] - cell["low"])
        state = lambda at, shard, over: F.struct(at.alias("at"), shard.alias("shard"), over.alias("over"))
        none = F.lit(-1)

        def heard(at: Column) -> Column:
            region = cell["first"] + index(draw("region", cell["first"]), cell["regions"])
            return F.when(at >= best["at"], state(at, none, F.lit(True))).otherwise(
                _with(region, lambda g: _with(g * racks + index(draw("rack", g), racks), lambda r: _with(r * leaves + index(draw("shard", r), leaves), lambda s: lands(at, s))))
            )

        def lands(at: Column, shard: Column) -> Column:
            height = cell["low"] + draw("height", shard) * (cell["high"] - cell["low"])
            counts = height < F.coalesce(F.get(weights, shard), F.lit(0.0))
            return state(at, F.when(counts, shard).otherwise(none), counts)

        return _with(run["at"] - F.ln(1 - draw("clock", cell["first"])) / room, heard)

    def search(best: Column, cell: Column) -> Column:
        step = lambda run, t: F.when(run["over"], run).otherwise(strike(best, cell, run, t))
        chunk = lambda run, c: F.when(run["over"], run).otherwise(F.aggregate(F.sequence(c * CHUNK, c * CHUNK + CHUNK - 1), run, step))
        start = F.struct(F.lit(0.0).alias("at"), F.lit(-1).alias("shard"), F.lit(False).alias("over"))
        done = F.aggregate(F.sequence(F.lit(0), F.lit(chunks - 1)), start, chunk)
        return _with(done, lambda d: F.when(d["shard"] >= 0, F.struct(d["at"].alias("at"), d["shard"].alias("shard"))).otherwise(best))

    listed = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(n).alias("regions"), F.lit(low).alias("low"), F.lit(high).alias("high")) for a, n, low, high in cells))
    nobody = F.struct(F.lit(math.inf).alias("at"), F.lit(-1).alias("shard"))
    found = F.aggregate(listed, nobody, search, lambda best: best["shard"])
    return F.when(found >= 0, found).otherwise(next(s for s, w in enumerate(root.weights) if w))


def place_of(root: Tree, shard: Column) -> tuple[Column, Column]:
    """(region, rack) of a shard, numbered in the tree's order."""
    rack = F.floor(shard / root.shards_per_rack).cast("int")
    return F.floor(rack / root.racks_per_region).cast("int"), rack


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None, rows_per_bucket: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard) for every row.

    The law is ``key``: the id and the tree decide. slot numbers a shard's rows from 0
    without gaps; grown_shard is the shard with one more in the tree. Slots are dealt in
    buckets of hashed ids, counted first, so that no task numbers a whole shard. Rows that
    share an id share a shard and get slots of their own; a null id is a key like another;
    a null text has size 1 and the crc32 of nothing. Other columns do not matter.
    """
    key = F.col("doc_id")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_size(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"),
    )
    now = tree(shards, weights=weights)
    rows = rows.withColumns({"shard": pick(now, key), "grown_shard": pick(tree(shards + 1, weights=weights), key)})
    rows = cut(rows)
    buckets = 1 << max(6, (rows.count() // (rows_per_bucket * shards)).bit_length())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    below = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    # shards * buckets offsets: one for some rows_per_bucket rows
    placed = rows.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["shard", "bucket"])
    region, rack = place_of(now, F.col("shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("k")).cast("long").alias("slot"), "grown_shard",
        region.alias("region"), rack.alias("rack"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", weights: dict[int, float] | None = None, files_per_shard: int = 16) -> None:
    """docs as Parquet under path, one folder a shard (its column is ``shard``, or that with
    underscores before it where docs have such a column); rows of a shard are dealt over
    several tasks and files, so that a shard need not fit one."""
    name = fresh("shard", docs.columns)
    named = docs.withColumn(name, pick(tree(shards, weights=weights), F.col(id_col)))
    named.repartition(shards * files_per_shard, name, F.pmod(F.xxhash64(F.col(id_col)), F.lit(files_per_shard))).write.partitionBy(name).parquet(path)
