"""Near-duplicates by the Jaccard similarity of shingle sets, verified exactly.

Candidates are the links of SimHash BK-trees and pairs that agree in a MinHash band (24
bands of 5: a pair of similarity 0.8 is missed about once in 14,000). A node is a distinct
set of shingles, so copies cost one entry. Each bucket is first compared with its least
node. Of members that this leaves apart, those of a bucket with few such pairs meet each
other; those of others meet only if they share one of the fifth of their shingles that are rarest
among such members. Similar sets always do (prefix filter: exact), while a passage that
many documents share does not pair them all.

The rows are written once to the shared folder with what is made of their texts. From
then on texts travel only for sets that have a candidate, and rows not at all while those
that go are few enough to be broadcast.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import dropped, folder, fresh, lean, short_batches, sliced, stored, swept
from .components import components
from .simhash import BITS, fingerprint_links

BANDS, ROWS = 24, 5

#: Numbers (8 bytes each) that are broadcast at most, after they were counted.
FEW = 1_000_000

#: Shingles of a block of members, about; a task holds two blocks.
BLOCK = 131_072


def _hashes(text: str | None, size: int, seed: int):
    """Hashes of the word shingles, as ``simhash.shingles`` has them; no list of them is held."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < size:
        words, size = [b" ".join(words)] if words else [], 1
    got = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, got, itertools.repeat(seed)), np.uint64, max(0, len(words) - size + 1))


def _node(unique) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(unique.tobytes()) - (1 << 63)


def _signer(names: list[str], size: int, seed: int, step: int = 4096):
    """Appends node, fp and bands to the rows, in place of their last column, the text; long
    texts are counted piece by piece."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
        powers = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        for batch in sliced(lean(batches), 64):
            nodes, prints, bands = [], [], []
            for text in batch.columns[-1]:
                h = _hashes(text.as_py(), size, seed)
                u = np.unique(h)
                ones, least = np.zeros(BITS, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(h), step):
                    ones += np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                for k in range(0, len(u), step):
                    least = np.minimum(least, (a * u[None, k : k + step] + b).min(1))
                nodes.append(_node(u))
                prints.append(((2 * ones > len(h)) * powers).sum(dtype=np.uint64))
                bands.append([xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))] if len(u) else [])
            made = [pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    return run


def _judge(size: int, least: float, seed: int):
    """The pairs (a, b) whose shingle sets are similar enough; sets are sorted hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(lean(batches), 32):
            kept, last, x = [], None, None
            a, b = (batch.column(c).to_pylist() for c in "ab")
            for k, pair in enumerate(zip(a, b, strict=True)):
                if pair[0] != last:
                    last, x = pair[0], np.unique(_hashes(batch.column("text_a")[k].as_py(), size, seed))
                y = np.unique(_hashes(batch.column("text_b")[k].as_py(), size, seed))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both):
                    kept.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in kept], pa.int64()), pa.array([p[1] for p in kept], pa.int64())], ["a", "b"])

    return run


def _shingler(size: int, seed: int):
    """One row for each distinct shingle of a text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(lean(batches), 32):
            sets = [np.unique(_hashes(x.as_py(), size, seed)) for x in batch.column("text")]
            n = [len(x) for x in sets]
            if sum(n):
                nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(np.array(n, np.int32), n)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "size", "shingle"])

    return run


def _prefix_pairs(members: DataFrame, texts: DataFrame, size: int, least: float, seed: int, base: str) -> DataFrame:
    """(a, b): pairs of different components that share a shingle of both prefixes. members
    has distinct node and component."""
    sets = stored(members.select("node").join(texts, "node").select("node", "text").mapInArrow(_shingler(size, seed), "node long, size int, shingle long"), f"{base}/shingles")
    # rarest first; ``least`` of the shingles must be shared, so one of the others and one more is
    seen = sets.groupBy("shingle").agg(F.count("*").alias("n"))
    order = Window.partitionBy("node").orderBy("n", "shingle")
    ranked = sets.join(seen, "shingle").withColumn("rk", F.row_number().over(order))
    prefix = ranked.where((F.col("rk") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1) & (F.col("n") > 1))
    prefix = stored(prefix.select("node", "size", "shingle").join(members, "node"), f"{base}/prefix")
    left, right = (prefix.select("shingle", F.col("node").alias(x), F.col("component").alias(f"of_{x}"), F.col("size").alias(f"n_{x}")) for x in "ab")
    long_enough = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
    return left.join(right, "shingle").where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & long_enough).select("a", "b")


def _setter(size: int, seed: int):
    """The sorted set of a text's shingles, as bytes, and their number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(lean(batches), 32):
            sets = [np.unique(_hashes(x.as_py(), size, seed)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "size", "set"])

    return run


def _block_judge(least: float):
    """The similar pairs of different components between the blocks i and j of a bucket."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
        sizes, nodes, of = (rows.column(c).to_numpy() for c in ("size", "node", "component"))
        # the shingles of the unit, numbered, and where each row's begin
        at = np.unique(np.frombuffer(b"".join(x.as_py() for x in rows.column("set")), np.uint64), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        right = np.flatnonzero(block == j[0])
        others = np.concatenate([at[ends[k] - sizes[k] : ends[k]] for k in right]) if len(right) else at[:0]
        starts, has, found = np.cumsum(sizes[right]) - sizes[right], np.zeros(len(at), np.uint8), []
        for k in np.flatnonzero(block == i[0]) if len(right) else ():
            own = at[ends[k] - sizes[k] : ends[k]]
            has[own] = 1
            both = np.add.reduceat(has[others], starts, dtype=np.int64)
            has[own] = 0
            close = (both >= least * (sizes[k] + sizes[right] - both)) & (of[right] != of[k]) & ((i[0] != j[0]) | (nodes[right] > nodes[k]))
            found += [(min(nodes[k], x), max(nodes[k], x)) for x in nodes[right[close]]]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _block_pairs(members: DataFrame, texts: DataFrame, size: int, least: float, seed: int, base: str | None = None) -> DataFrame:
    """(a, b): the similar pairs of a bucket's members of different components. members has
    band, node and component. A bucket is dealt into blocks by its members' shingles, so no
    group has to fit one task, and each two blocks are a unit of their own."""
    base = base or folder(members.sparkSession, "blocks")
    sets = stored(members.select("node").distinct().join(texts, "node").select("node", "text").mapInArrow(_setter(size, seed), "node long, size long, set binary"), f"{base}/sets")
    sized = members.join(sets.select("node", "size"), "node")
    blocks = sized.groupBy("band").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    units = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "component", "size", "set")
    return units.groupBy("band", "i", "j").applyInArrow(_block_judge(least), "a long, b long")


def _few(numbers: DataFrame) -> DataFrame:
    """Marked for broadcast if counted few; else Spark joins by shuffle."""
    return F.broadcast(numbers) if numbers.count() <= FEW else numbers


def _signed(docs: DataFrame, text_col: str, size: int, seed: int) -> tuple[DataFrame, list[str]]:
    """docs, read back from the shared folder with a number of each row and the node, fp and
    bands of its text; the names of these four."""
    names = [fresh(x, docs.columns) for x in ("row", "node", "fp", "bands")]
    fed = docs.select("*", F.monotonically_increasing_id().alias(names[0]), F.col(text_col).cast("string").alias(fresh("text_", docs.columns)))
    kinds = [LongType(), LongType(), LongType(), ArrayType(LongType())]
    schema = StructType([*docs.schema.fields, *map(StructField, names, kinds)])
    with short_batches(docs.sparkSession):
        return stored(fed.mapInArrow(_signer(schema.names, size, seed), schema), folder(docs.sparkSession, "signed")), names


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, least: float = 0.8, seed: int = 42, small: int = 500_000, dense: int = 4) -> DataFrame:
    """(node, least_id, component) of every distinct set of shingles; sets whose Jaccard
    similarity is ``least`` or more are linked. Texts without a word are one node. The
    result is the same for every ``small`` and ``dense``, the most pairs of a bucket that all
    meet, and the most for each of its members that meet as rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = folder(docs.sparkSession, "groups")
    return _grouped(_signed(rows, "text", size, seed)[0], size, least, seed, small, dense, base).select("node", "lead.least_id", "component")


def _grouped(rows: DataFrame, size: int, least: float, seed: int, small: int, dense: int, base: str) -> DataFrame:
    """(node, lead, component) from rows of doc_id, text, row, node, fp, bands; lead is the
    least id of a node and the first row that has it, null where no row has an id. What it
    reads is stored under base."""
    with swept(rows.sparkSession):
        nodes, joined = _joined(rows, size, least, seed, small, dense, base)
    return nodes.join(joined, "node", "left").select("node", "lead", F.coalesce("component", "node").alias("component"))


def _joined(rows: DataFrame, size: int, least: float, seed: int, small: int, dense: int, base: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the components of those that have a link."""
    lead = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("least_id"), "row"))
    nodes = stored(rows.groupBy("node").agg(F.min(lead).alias("lead"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands")), f"{base}/nodes")
    # SimHash: nodes of one fingerprint, and BK-tree links between fingerprints
    reps = nodes.where(F.size("bands") > 0).groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(reps, "fp").where("node <> rep and size(bands) > 0").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    close = same.unionByName(fingerprint_links(reps))
    # MinHash: the members of each band's bucket
    members = nodes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(members.join(buckets, "band"), f"{base}/members")
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = stored(ordered(close.unionByName(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))), f"{base}/first")
    wanted = first.select(F.explode(F.array("a", "b")).alias("want")).distinct()
    texts = stored(rows.select("node", "text").join(_few(wanted), F.col("node") == F.col("want"), "left_semi").groupBy("node").agg(F.any_value("text").alias("text")), f"{base}/texts")

    def similar(pairs: DataFrame) -> DataFrame:
        one, other = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(_judge(size, least, seed), "a long, b long")

    with short_batches(rows.sparkSession):
        links = stored(similar(first), f"{base}/links")
    joined = components(links, base=f"{base}/near")
    # pairs of a bucket that the hubs left apart
    placed = members.join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    # how many pairs of a bucket's members lie in different components
    sizes = placed.groupBy("band", "component").agg(F.count("*").cast("double").alias("m")).groupBy("band").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
    apart = sizes.select("band", "m", ((F.col("m") * F.col("m") - F.col("own")) / 2).alias("crossing")).where("crossing > 0")
    # rows of pairs grow with the members, and not with the square of a bucket
    way = F.when(F.col("crossing") > small, "prefixes").when(F.col("crossing") > dense * F.col("m"), "blocks").otherwise("pairs")
    placed = stored(placed.join(apart.select("band", way.alias("way")), "band"), f"{base}/placed")
    left, right = (placed.where("way = 'pairs'").select("band", F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    second = left.join(right, "band").where("a < b and of_a <> of_b").select("a", "b")
    many = placed.where("way = 'prefixes'").select("node", "component").distinct()
    second = ordered(second.unionByName(_prefix_pairs(many, texts, size, least, seed, base))).join(first, ["a", "b"], "left_anti")
    with short_batches(rows.sparkSession):
        more = similar(second).unionByName(_block_pairs(placed.where("way = 'blocks'").select("band", "node", "component"), texts, size, least, seed, base))
        more = stored(more, f"{base}/more")
    joined = components(links.unionByName(more), base=f"{base}/all")
    return nodes, joined


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, least: float = 0.8, seed: int = 42, small: int = 500_000, dense: int = 4) -> DataFrame:
    """One row of each group, that of its smallest id; columns as they come. Rows that share
    an id but not a group are kept apart; rows without an id stay."""
    void = {c for c, kind in docs.dtypes if kind == "void"}  # no file format stores these
    rows, (row, node, fp, bands) = _signed(docs.withColumns({c: F.col(c).cast("string") for c in void}), text_col, size, seed)
    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(x) for c, x in ((row, "row"), (node, "node"), (fp, "fp"), (bands, "bands"))))
    spark = docs.sparkSession
    base, last = folder(spark, "groups"), folder(spark, "gone")
    grouped = _grouped(own, size, least, seed, small, dense, base).where("lead is not null").select("node", "component", "lead")
    with swept(spark):
        found = stored(grouped, f"{base}/found")
        first = found.groupBy("component").agg(F.min(F.struct("lead.least_id", "node", "lead.row")).alias("f")).select("component", F.col("f.row").alias("first"))
        gone = own.where("doc_id is not null").select("row", "node").join(found.join(first, "component").select("node", "first"), "node").where("row <> first")
        gone = _few(stored(gone.select(F.col("row").alias(row)), last))
    dropped(spark, base)
    return rows.join(gone, row, "left_anti").select(*(F.lit(None).alias(c) if c in void else F.col(c) for c in docs.columns))
