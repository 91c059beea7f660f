"""Hard negatives by exact integer scores, from matrix products in residue number systems.

Components are integers, and a score is an inner product. Both matrices are reduced modulo
several small primes; the residues' products are sums below 2^24, which float32 matrix
products give exactly; and the signed score is put together from its residues by Chinese
remaindering, since the product of the primes is more than twice any score.

Anchors and candidates meet in blocks: each block of anchors with each block of candidates is
one bounded group of a Spark cogroup, and only the best of a block leave it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Squared lengths of quantised vectors that 63-bit scores can hold with room.
MOST = float(1 << 58)


def primes_for(bound: int, dims: int) -> tuple[list[int], int]:
    """(primes, columns of a partial product): odd primes whose product passes twice the
    bound, of which so many products of centred residues add up below 2^24."""
    columns = max(1, min(dims, 256))
    top = 2 * math.isqrt((1 << 24) // columns) + 1
    found, total = [], 1
    for p in range(top if top % 2 else top - 1, 2, -2):
        if (p // 2) ** 2 * columns < 1 << 24 and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            total *= p
            if total > 2 * bound + 1:
                return found, columns
    raise ValueError("no set of primes reaches the bound")


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """For each prime the matrix of centred residues, in float32."""
    out = []
    for p in primes:
        r = x % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def scores(a: list[np.ndarray], c: list[np.ndarray], primes: list[int], columns: int) -> np.ndarray:
    """Exact inner products of the rows of a with those of c, both as residues: mixed-radix
    digits, one prime after the other, then the centred value."""
    total, base = np.zeros((a[0].shape[0], c[0].shape[0]), np.int64), 1
    for k, p in enumerate(primes):
        r = np.zeros(total.shape, np.int64)
        for lo in range(0, a[k].shape[1], columns):
            r += (a[k][:, lo : lo + columns] @ c[k][:, lo : lo + columns].T).astype(np.int64)
        digit = (r - total) % p * pow(base, -1, p) % p
        total += digit * base
        base *= p
    total[total > base // 2] -= base
    return total


def _matrix(column, dims: int) -> np.ndarray:
    """floor(256 x) of a list column of doubles, as int64 rows filled up with zeros."""
    import pyarrow as pa

    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = np.asarray(lists.flatten(), np.float64), np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(256 * flat)
    return out


def _best(order: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k of these places with the highest scores; earlier places first among equals."""
    if len(order) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        more, same = order[score > least], order[score == least]
        order = np.concatenate((more, same[: k - len(more)]))
    return order


class _Blocks:
    """Scores of one block of anchors with one block of candidates, some anchors at a time."""

    def __init__(self, anchors, rows, primes, columns, dims) -> None:
        by_id = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
        rows = rows.take(by_id)
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.a_ids, self.a_labels = anchors.column("a_id").to_numpy(), anchors.column("a_label").to_numpy()
        self.a, self.c = _matrix(anchors.column("a_v"), dims), residues(_matrix(rows.column("v"), dims), primes)
        self.primes, self.columns = primes, columns

    def __iter__(self, step: int = 256):
        for lo in range(0, len(self.a), step):
            part = scores(residues(self.a[lo : lo + step], self.primes), self.c, self.primes, self.columns)
            yield from enumerate(part, lo)


def _positives(primes, columns, dims, k):
    def run(key, left, right):
        import pyarrow as pa

        got, blocks = [], _Blocks(left, right, primes, columns, dims)
        for i, row in blocks:
            at = np.flatnonzero((blocks.labels == blocks.a_labels[i]) & (blocks.ids != blocks.a_ids[i]))
            at = _best(at, row[at], k)
            got.append((np.full(len(at), blocks.a_ids[i]), blocks.ids[at], row[at]))
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), cols, strict=True)))

    return run


def _negatives(primes, columns, dims, k, low, high):
    def run(key, left, right):
        import pyarrow as pa

        got, blocks = [], _Blocks(left, right, primes, columns, dims)
        windows = left.column("scores").to_pylist()
        for i, row in blocks:
            other = np.flatnonzero(blocks.labels != blocks.a_labels[i])
            mine = row[other]
            for s in set(windows[i] or ()):
                least, most = -(-low * s // 100), high * s // 100
                inside = (mine >= least) & (mine <= most)
                at = _best(other[inside], mine[inside], k)
                got.append((np.full(len(at), blocks.a_ids[i]), np.full(len(at), s), blocks.ids[at], row[at]))
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor_id", "positive_score", "negative_id", "negative_score"), cols, strict=True)))

    return run


def _first(df: DataFrame, by: list[str], score: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows by score, then key; blocks have at most k each, and Spark keeps k of
    a partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.col(key))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine(
    vectors: DataFrame, anchors, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_block: int = 2048, block: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of another label whose score lies between low and high per cent of the
    positive's. Scores are inner products of floor(256 x); the higher comes first, then the
    smaller id.

    ``anchors`` is a condition on the columns. Rows with a null id, label or vector, or with a
    component that is null or not finite, take no part; nor do vectors whose quantised
    squared length passes 2^58, whose scores 64 bits might not hold. Of rows that share an id
    the one of the least label, then vector, counts. Shorter vectors end in zeros. Negative
    windows are empty: a positive score below zero has no negatives. The work is anchors times
    rows by contract; a task holds one block of each.
    """
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(F.coalesce(finite, F.lit(True)))
    # an upper bound of the quantised squared length, since |floor(y)| <= |y| + 1
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + 256 * e * 256 * e)) + F.sqrt(F.size(x))
    rows = rows.withColumn("bound", length * length).where(F.col("bound") < MOST)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor", "bound")).alias("r")).select("vec_id", "r.*")
    rows = cut(rows)
    n, n_anchors, bound, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.max("bound"), F.max(F.size("v"))).first()
    primes, columns = primes_for(int(bound or 0) + 1, max(1, dims or 1))
    a_blocks, c_blocks = max(1, -(-n_anchors // anchor_block)), max(1, -(-n // block))
    # ids are dealt to blocks by their hash, so blocks are near equal whatever the ids or labels
    mine_a = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(a_blocks)).cast("int")
    mine_c = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(c_blocks)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.where("anchor").select(F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), mine_a.alias("block_a"))
    right = rows.select("vec_id", "label", "v", mine_c.alias("block_c")).withColumn("of_a", every(a_blocks)).groupBy("of_a", "block_c")
    meet = lambda some, how, schema: some.withColumn("block_of", every(c_blocks)).groupBy("block_a", "block_of").cogroup(right).applyInArrow(how, schema)
    near = meet(left, _positives(primes, columns, max(1, dims or 1), positives), "anchor_id long, positive_id long, positive_score long")
    near = cut(_first(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))
    wanted = near.groupBy(F.col("anchor_id").alias("a_id")).agg(F.collect_set("positive_score").alias("scores"))
    left = left.join(wanted, "a_id")
    far = meet(left, _negatives(primes, columns, max(1, dims or 1), negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    far = _first(far, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
