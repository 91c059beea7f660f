"""SimHash near-duplicates found with BK-trees.

Fingerprints are made where the texts are; only distinct fingerprints travel. Two that
differ in at most ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` bit
blocks, so each choice of that many blocks gives a sharding in which linked fingerprints
meet. Every shard becomes a BK-tree (children keyed by their integer distance to the
parent), and a look-up follows only the edges within the radius. A shard larger than
``shard_rows`` is dealt into chunks and each pair of chunks is a task unit of its own: the
tree of one is searched for the rows of the other, so no group has to fit one task.

The trees reach the executors by shuffle and not by broadcast: their total size follows
the corpus and has no bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, fresh
from .components import components

BITS = 64


class BKTree:
    """A metric tree over integers under the Hamming distance."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple[int, int, dict] | None = None

    def add(self, code: int, label: int) -> None:
        if self.root is None:
            self.root = (code, label, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ code).bit_count()
            below = node[2].get(d)
            if below is None:
                node[2][d] = (code, label, {})
                return
            node = below

    def within(self, code: int, radius: int) -> Iterator[int]:
        """Labels of the entries at most radius bits away."""
        todo = [self.root] if self.root else []
        while todo:
            at, label, edges = todo.pop()
            d = (at ^ code).bit_count()
            if d <= radius:
                yield label
            lo, hi = d - radius, d + radius
            if len(edges) > 2 * radius + 1:
                todo.extend(edges[k] for k in range(lo, hi + 1) if k in edges)
            else:
                todo.extend(n for k, n in edges.items() if lo <= k <= hi)


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_links(codes: list[int], left: list[bool] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links among codes; with left, of the links
    between the entries of the left chunk and the others only."""
    parent, links, tree, sets = list(range(len(codes))), [], BKTree(), 0
    if left is not None:
        for i, c in enumerate(codes):
            if left[i]:
                tree.add(c, i)
    for i, c in enumerate(codes):
        if left is not None and left[i]:
            continue
        sets += 1
        for j in tree.within(c, radius):
            x, y = _find(parent, i), _find(parent, j)
            if x != y:
                parent[x] = y
                links.append((i, j))
                sets -= 1
                if sets == 1 and left is None:  # all that was read hangs together
                    break
        if left is None:
            tree.add(c, i)
    return links


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined word shingles, repeats included; A-Z are lower-cased; words are split
    at ASCII white space. Fewer words than size give one shingle of them all, none give none."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def _fingerprinter(size: int, seed: int, names: list[str], step: int = 200_000):
    """Appends the fingerprint to the rows, in place of their last column, the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest, again = xxhash.xxh64_intdigest, itertools.repeat(seed)

        def ones(hashes: list[int]) -> np.ndarray:
            h = np.fromiter(hashes, np.uint64, len(hashes))
            return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

        for batch in batches:
            out, hashes, lengths = np.zeros(batch.num_rows, np.uint64), [], []
            powers = np.uint64(1) << np.arange(BITS, dtype=np.uint64)

            def flush(first: int) -> None:
                n = np.array(lengths)
                some = n > 0
                if some.any():
                    starts = (np.cumsum(n) - n)[some]
                    counts = np.add.reduceat(ones(hashes), starts, axis=0, dtype=np.int64)
                    out[first + np.flatnonzero(some)] = ((2 * counts > n[some, None]) * powers).sum(1, dtype=np.uint64)
                hashes.clear()
                lengths.clear()

            first = 0
            for i, text in enumerate(batch.columns[-1]):
                got = shingles(text.as_py(), size)
                if len(got) > step:  # a very long text is counted piece by piece
                    flush(first)
                    counts = sum(ones(list(map(digest, got[k : k + step], again))).sum(0, dtype=np.int64) for k in range(0, len(got), step))
                    out[i] = ((2 * counts > len(got)) * powers).sum(dtype=np.uint64)
                    first = i + 1
                    continue
                hashes.extend(map(digest, got, again))
                lengths.append(len(got))
                if len(hashes) > step:
                    flush(first)
                    first = i + 1
            if lengths:
                flush(first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.view(np.int64))], names)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash as a signed long; null and blank texts give zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprinter(size, seed, ["doc_id", "fp"]), "doc_id long, fp long")


def _shard_keys(radius: int, blocks: int):
    """One key for every choice of the blocks that must agree."""
    at = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (at[k + 1] - at[k])) - 1) << at[k] for k in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    return F.array(*keys)


def _linker(radius: int):
    """Reads task units one after the other (rows are sorted by unit)."""

    def run(batches):
        import pyarrow as pa

        def links(rows):
            codes = [r[1] & 0xFFFFFFFFFFFFFFFF for r in rows]
            i, j = rows[0][0][-2:]
            left = [r[2] == i for r in rows] if i != j else None
            return [(rows[x][3], rows[y][3]) for x, y in shard_links(codes, left, radius)]

        unit, rows, found = None, [], []

        def out():
            got = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
            found.clear()
            return got

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *key, fp, chunk, doc in zip(*cols, strict=True):
                if key != unit:
                    if len(rows) > 1:
                        found.extend(links(rows))
                    unit, rows = key, []
                rows.append((key, fp, chunk, doc))
            yield out()
        if len(rows) > 1:
            found.extend(links(rows))
        yield out()

    return run


def _recut(hot: DataFrame, radius: int) -> DataFrame:
    """(t, k, c, part, fp, rep): the rows of large shards (t, k, fp, rep) once for each choice
    c of half of the shard's own blocks, with the bits of those as part."""
    blocks = 2 * radius
    bits = hot.groupBy("t", "k").agg(F.count("*").alias("n"), F.array(*(F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.expr("1L"))) for b in range(BITS))).alias("ones"))
    # the most varied bits first; fixed ones do not matter
    order = F.array_sort(F.transform("ones", lambda x, b: F.struct(F.abs(2 * x - F.col("n")).alias("gap"), b.alias("bit"))))

    def mask_of(j: int):
        own = F.filter("order", lambda _, r: r % blocks == j)
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.expr("1L"), x["bit"])))

    dealt = bits.withColumn("order", order).select("t", "k", *(mask_of(j).alias(f"m{j}") for j in range(blocks)))
    parts = []
    for c, chosen in enumerate(itertools.combinations(range(blocks), radius)):
        mask = F.col(f"m{chosen[0]}")
        for j in chosen[1:]:
            mask = mask.bitwiseOR(F.col(f"m{j}"))
        parts.append(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(mask).alias("part")))
    return hot.join(dealt, ["t", "k"]).select("t", "k", F.explode(F.array(*parts)).alias("p"), "fp", "rep").select("t", "k", "p.c", "p.part", "fp", "rep")


def fingerprint_links(reps: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = 2048) -> DataFrame:
    """(a, b): links that join everything within the radius; reps has distinct (fp, rep).

    More blocks mean smaller shards and more copies of each fingerprint: 5 suit up to some
    10^9 distinct fingerprints, 6 go beyond. The result is the same, and so it is for every
    ``shard_rows``, from which shards are cut again.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    rows = reps.select("fp", "rep", F.explode(_shard_keys(radius, blocks)).alias("s")).select("s.t", "s.k", "fp", "rep")
    counted = rows.join(rows.groupBy("t", "k").agg(F.count("*").alias("size")).where("size > 1"), ["t", "k"])
    if radius:
        whole = counted.where(F.col("size") <= shard_rows).select("t", "k", F.lit(-1).alias("c"), F.lit(0).cast("long").alias("part"), "fp", "rep", F.lit(1).alias("chunks"))
        parts = _recut(counted.where(F.col("size") > shard_rows).drop("size"), radius)
    else:  # distinct fingerprints have no links
        return reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    sizes = parts.groupBy("t", "k", "c", "part").count().where("count > 1")
    parts = parts.join(sizes, ["t", "k", "c", "part"]).withColumn("chunks", F.ceil(F.col("count") / shard_rows).cast("int")).drop("count")
    c = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = F.expr("transform(sequence(0, chunks - 1), x -> struct(least(dealt, x) as i, greatest(dealt, x) as j))")
    dealt = whole.unionByName(parts).withColumn("dealt", c).withColumn("u", F.explode(units))
    unit = ["t", "k", "c", "part", "i", "j"]
    dealt = dealt.select("t", "k", "c", "part", "u.i", "u.j", "fp", "dealt", "rep")
    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_linker(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, seed: int = 42, radius: int = 3, blocks: int = 5, shard_rows: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the smallest doc_id that links reach, itself included. Equal texts
    share a fingerprint, so copies cost one entry. A row without doc_id links others but
    names no component (its component_id is null where no row has one). Null, empty and
    blank texts have fingerprint zero and are linked like any other; repeated rows stay.
    Other columns of docs are not looked at. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, size, seed))
    named = _named(prints, radius, blocks, shard_rows)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint: its component's least
    fingerprint and least id."""
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # several fingerprints may share their least id, so nodes are fingerprints
    linked = components(fingerprint_links(reps.select("fp", F.col("fp").alias("rep")), radius, blocks, shard_rows))
    placed = reps.join(linked, reps["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(least, "component").select("fp", "component", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, seed: int = 42, radius: int = 3, blocks: int = 5, shard_rows: int = 2048) -> DataFrame:
    """One row of each near-duplicate group, that of its smallest id; columns as they come.

    Rows and not ids are chosen: of two groups whose least row has the same id, each keeps
    its own. Rows without an id stay.
    """
    fp, key = fresh("fp", docs.columns), fresh("key", docs.columns)
    own = docs.where(F.col(id_col).isNotNull())
    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    fed = own.select("*", F.col(text_col).cast("string").alias(fresh("text_", docs.columns)))
    rows = cut(fed.mapInArrow(_fingerprinter(size, seed, schema.names), schema))
    prints = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    named = _named(prints, radius, blocks, shard_rows)
    # the least row of a group: the id that names it, and of its fingerprints the least
    first = prints.join(named, "fp").where("doc_id = component_id").groupBy(F.col("component_id").alias(key), "component").agg(F.min("fp").alias("least_fp"))
    first = first.select(key, F.col("least_fp").alias(fp))
    kept = rows.withColumn(key, F.col(id_col).cast("long")).join(first, [key, fp]).dropDuplicates([key, fp]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
