"""Latent semantic ranking: a truncated SVD of a catalogue's TF-IDF rows, and the rank of each
text's declared code among all codes by cosine in that space.

The SVD is a randomised subspace iteration. The catalogue's rows stay distributed; the basis,
one row of components for each term of the catalogue's vocabulary, is what driver and workers
hold, and its size is checked. Texts meet the catalogue in broadcast blocks of bounded size,
one at a time, so nothing of a text is shuffled and no pair of text and code is a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import FOUND, Catalogue, first_codes, found_batch, ranks_once, shared_codes

#: Bytes of a basis, and of a catalogue's vectors, that are held and broadcast at most.
MOST = 1 << 30


@dataclass
class Space:
    """Terms (sorted), their rows of the basis, and the singular values."""

    terms: DataFrame  # (term, j)
    basis: np.ndarray
    singular: np.ndarray


def _sparse(weights: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, j, w): each row's term numbers and weights as two arrays."""
    pairs = weights.join(terms, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("_c"))
    return pairs.select(key, F.col("_c.j").alias("j"), F.col("_c.w").alias("w"))


def _times(batch, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the batch times the basis, row number of each entry, term, weight)."""
    j, w = batch.column("j"), batch.column("w")
    sizes = np.asarray(j.value_lengths().fill_null(0), np.int64)
    row, term, weight = np.repeat(np.arange(len(sizes)), sizes), np.asarray(j.flatten(), np.int64), np.asarray(w.flatten(), np.float64)
    return _product(row, term, weight, len(sizes), basis), row, term, weight


def _product(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows (ordered) times the basis, the entries of some rows at a time."""
    out = np.zeros((n, basis.shape[1]))
    for lo in range(0, n, 512):
        a, z = np.searchsorted(row, (lo, lo + 512))
        if z > a:
            starts = np.flatnonzero(np.diff(row[a:z], prepend=-1))
            out[row[a:z][starts]] = np.add.reduceat(weight[a:z, None] * basis[term[a:z]], starts)
    return out


def fit(weights: DataFrame, key: str, rank: int = 150, more: int = 20, rounds: int = 8, seed: int = 7) -> Space:
    """The best ``rank`` right singular directions of the rows (key, term, w), or all.

    Each round multiplies the basis by the rows' gram matrix: a partition adds up what its own rows give,
    Spark sums the partitions' parts for every term, and the driver makes the small result
    orthonormal again. ``more`` spare directions speed up what converges; with at least as
    many directions as the rows have, one round is exact. A basis above MOST bytes is an error.
    """
    spark = weights.sparkSession
    ordered = [r.term for r in weights.select("term").distinct().orderBy("term").limit(MOST // 8).collect()]
    n = len(ordered)
    width = min(n, rank + more)
    if n * width * 8 > MOST:
        raise ValueError(f"a basis of {n} terms and {width} components is too large")
    terms = spark.createDataFrame(list(zip(ordered, range(n), strict=True)), "term string, j int")
    if not n:
        return Space(terms, np.zeros((0, 0)), np.zeros(0))
    rows = _sparse(weights, terms, key)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(basis)

        def part(batches, shared=shared):
            import pyarrow as pa

            q = shared.value
            total = np.zeros_like(q)
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    y, row, term, weight = _times(batch.slice(lo, 4096), q)
                    for a in range(0, len(row), 1 << 16):
                        np.add.at(total, term[a : a + (1 << 16)], weight[a : a + (1 << 16), None] * y[row[a : a + (1 << 16)]])
            some = np.flatnonzero(np.abs(total).sum(1))
            flat = pa.array(total[some].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, q.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], ["j", "v"])

        parts = rows.select("j", "w").mapInArrow(part, "j int, v array<double>")
        summed = parts.groupBy("j").agg(F.array(*(F.sum(F.get("v", F.lit(c))) for c in range(width))).alias("v")).toPandas()
        z = np.zeros_like(basis)
        z[summed["j"].to_numpy()] = np.stack(summed["v"].to_numpy())
        square, turn = np.linalg.eigh((basis.T @ z + z.T @ basis) / 2)  # the gram matrix inside the basis
        square, turn = square[::-1], turn[:, ::-1]
        last, found = basis @ turn, np.sqrt(np.maximum(square, 0))
        if width == n or np.linalg.norm(z @ turn[:, :rank] - last[:, :rank] * square[:rank]) <= 1e-9 * max(square[0], 1e-300):
            break
        basis = np.linalg.qr(z)[0]
    # directions without any weight are none
    kept = min(rank, int((found > 1e-7 * max(found[0], 1e-300)).sum()))
    return Space(terms, last[:, :kept], found[:kept])


def vectors(weights: DataFrame, space: Space, key: str, into: str = "vector") -> DataFrame:
    """(key, vector): unit vectors of rows (key, term, w) in the space; rows of no known term
    have none."""
    shared = weights.sparkSession.sparkContext.broadcast(space.basis)
    kind = dict(weights.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([some.column(0), _lists(_unit(_times(some, shared.value)[0]))], [key, into])

    return _sparse(weights, space.terms, key).mapInArrow(run, f"`{key}` {kind}, `{into}` array<double>")


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 1e-12)


def _lists(m: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1])) if m.shape[1] else np.zeros(len(m) + 1), pa.int32()), pa.array(m.ravel()))


def rank_all(
    texts: DataFrame, catalogue: Catalogue, space: Space, codes: DataFrame, key: str, terms: Column, declared: str, code: str, vector: str = "vector",
    k: int = 3, decimals: int = 9, block: int = 8192,
) -> DataFrame:
    """One row a text (key, declared code): similarity and rank of its declared code among all
    ``codes`` (code, vector), the k most similar codes, and the digits that the best shares
    with it.

    As match.rank_declared: ranks count the codes that are strictly more similar. Texts are
    weighed by the fitted catalogue and taken into the space where they are. A text of no
    known term has similarity zero to every code, and rank one. The codes' vectors, of MOST
    bytes at most, are broadcast in blocks; a batch is scored with one block after the other.
    """
    sc = texts.sparkSession.sparkContext
    n, width = codes.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    if n * max(width, 1) * 8 > MOST:
        raise ValueError(f"a catalogue of {n} codes and {width} components is too large")
    held = codes.select(code, vector).orderBy(code).toPandas()
    names = held[code].to_numpy(object)
    matrix = np.stack(held[vector].to_numpy()).astype(np.float64) if n else np.zeros((0, 0))
    blocks = [sc.broadcast((names[lo : lo + block], matrix[lo : lo + block])) for lo in range(0, n, block)]
    order = {r.term: r.j for r in space.terms.collect()}
    known = np.array([order[t] for t in catalogue.terms], np.int64)
    weighing, basis = sc.broadcast(catalogue), sc.broadcast(space.basis[known] if len(known) else space.basis)
    types = dict(texts.dtypes)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                row, j, w = weighing.value.weigh(batch.column(2))
                t = _unit(_product(row, j, w, batch.num_rows, basis.value))
                given = np.array([x or "" for x in batch.column(1).to_pylist()], object)
                own, listed = np.zeros(len(t)), np.zeros(len(t), bool)
                for b in blocks:  # the declared codes first
                    ids, m = b.value
                    at = np.minimum(np.searchsorted(ids, given), len(ids) - 1)
                    here = ids[at] == given
                    own[here], listed[here] = np.round((t[here] * m[at[here]]).sum(1), decimals), True
                above, best = np.zeros(len(t), np.int64), [[] for _ in t]
                for b in blocks:
                    ids, m = b.value
                    s = np.round(t @ m.T, decimals)
                    above += (s > own[:, None]).sum(1)
                    for i in range(len(t)):
                        best[i] = sorted(best[i] + first_codes(ids, s[i], k), key=lambda x: (-x[1], x[0]))[:k]
                yield found_batch(batch, ["_id", declared], [(float(own[i]) if listed[i] else None, int(above[i]), best[i]) for i in range(len(t))])

    fed = texts.select(key, declared, terms.alias("_terms"))
    find = lambda some: some.mapInArrow(run, f"_id string, `{declared}` {types[declared]}, {FOUND}")
    return ranks_once(fed, shared_codes(texts.sparkSession, names), catalogue.terms, key, declared, find)
