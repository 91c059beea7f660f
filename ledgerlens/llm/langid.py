"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes of depths 0 to 3 with the counts of what
followed. A byte's code length comes from the deepest context seen in that language;
a byte not seen there costs an escape (method C: distinct / (total + distinct)) and is
coded one context shorter, down to a uniform code over 256 bytes. The counts are frozen
after training, so the code length of a byte depends on the last four bytes only and can be
written out: a hashed table has a row of code lengths, one for each language, for every
(context, byte) that any language has seen, and one of escapes for every context. A byte is
looked up at depth 3; where nobody has seen it there, the escapes of the context are added
and it is looked up one depth shorter. A text's code length is the exact sum over all its
bytes; the language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import cut, fresh, sliced, unit_hash

DEPTH = 3


def _gram_counter(batches):
    """Counts of (language, four bytes) in a batch; texts start after three zero bytes."""
    import pyarrow as pa

    for batch in batches:
        langs, grams, counts = [], [], []
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                by.setdefault(lang, []).append(text.encode())
        for lang, texts in by.items():
            parts = []
            for t in texts:
                parts.append(_grams(np.frombuffer(b"\0\0\0" + t, np.uint8)))
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(g)
            grams.append(g.astype(np.int64))
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)), pa.array(np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64))],
            ["lang", "gram", "n"],
        )


class _Index:
    """Positions of distinct keys (longs from 0) in an open-addressing table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.place = np.zeros(1 << self.bits, np.int32)
        todo, at = np.arange(len(keys)), self._start(keys)
        while len(todo):
            free = self.slots[at] < 0
            spots, first = np.unique(at[free], return_index=True)
            set_now = todo[free][first]
            self.slots[spots], self.place[spots] = keys[set_now], set_now
            left = self.slots[at] != keys[todo]
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The key's position, or -1."""
        at = self._start(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.place[at], -1)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            seen = self.slots[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.place[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


@dataclass
class ContextTrees:
    """The frozen trees. Keys of depth d are the last d bytes (contexts) or d + 1 bytes
    (pairs) as one number, times 4, plus d. pairs -> row of cost, contexts -> row of escape:
    bits for each language. limits has the bits per byte up to which a text is taken for one
    of a language, where they were asked for."""

    langs: list[str]
    pairs: _Index
    cost: np.ndarray
    contexts: _Index
    escape: np.ndarray
    limits: dict[str, float] | None = None

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.cost, self.escape, self.pairs.slots, self.pairs.place, self.contexts.slots, self.contexts.place))

    @staticmethod
    def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
        langs = sorted(counts)
        costs, escapes, keys, above = [], [], [], []
        before, shorter = np.full((1, len(langs)), 8.0, np.float32), np.zeros(1, np.int64)  # below depth 0: any of 256 bytes
        for depth in range(DEPTH + 1):
            mask, low = (1 << 8 * (depth + 1)) - 1, (1 << 8 * depth) - 1
            own = {}
            for lang, (g, n) in counts.items():
                p, at = np.unique(g & mask, return_inverse=True)
                own[lang] = p, np.bincount(at, n, len(p))
            mine = np.unique(np.concatenate([p for p, _ in own.values()]))
            ctx, of = np.unique(mine >> 8, return_inverse=True)
            cost = before[np.searchsorted(shorter, mine & low)] if depth else np.repeat(before, len(mine), 0)
            escape = np.zeros((len(ctx), len(langs)), np.float32)
            for k, lang in enumerate(langs):
                p, n = own[lang]
                at = np.searchsorted(mine, p)
                total, kinds = np.bincount(of[at], n, len(ctx)), np.bincount(of[at], minlength=len(ctx))
                has = total > 0
                escape[has, k] = np.log2(total[has] + kinds[has]) - np.log2(kinds[has])
                cost[:, k] += escape[of, k]
                cost[at, k] = np.log2((total + kinds)[of[at]]) - np.log2(n)
            costs.append(cost)
            escapes.append(escape)
            keys.append(mine * 4 + depth)
            above.append(ctx * 4 + depth)
            before, shorter = cost, mine
        return ContextTrees(langs, _Index(np.concatenate(keys)), np.concatenate(costs), _Index(np.concatenate(above)), np.concatenate(escapes))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each gram of four bytes, one row for each."""
        at = self.pairs.find(grams * 4 + DEPTH)
        out = self.cost[at]
        todo = np.flatnonzero(at < 0)
        if len(todo):
            rest = np.zeros((len(todo), len(self.langs)), np.float32)
            left, g = np.arange(len(todo)), grams[todo]
            for depth in range(DEPTH, -1, -1):
                at = self.pairs.find((g & ((1 << 8 * (depth + 1)) - 1)) * 4 + depth)
                hit = at >= 0
                rest[left[hit]] += self.cost[at[hit]]
                left, g = left[~hit], g[~hit]
                ctx = self.contexts.find(((g >> 8) & ((1 << 8 * depth) - 1)) * 4 + depth)
                some = ctx >= 0
                rest[left[some]] += self.escape[ctx[some]]
            rest[left] += 8
            out[todo] = rest
        return out

    def code_lengths(self, texts: list[bytes], step: int = 1 << 17) -> np.ndarray:
        """Bits for each text under each language; every byte counts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        buf = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), np.uint8)
        ends = np.cumsum(lengths + DEPTH)
        starts = ends - lengths
        for a in range(0, len(buf), step):
            b = min(a + step, len(buf))
            lo = np.searchsorted(ends, a, side="right")
            hi = np.searchsorted(starts, b, side="left")
            s, e = np.maximum(starts[lo:hi], a), np.minimum(ends[lo:hi], b)
            some = e > s
            if not some.any():
                continue
            s, e = s[some], e[some]
            first = s[0]
            bits = self.bits(_grams(buf[first - DEPTH : e[-1]]))
            cuts = np.empty(2 * len(s), np.int64)
            cuts[::2], cuts[1::2] = s - first, e - first
            sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]), bits.dtype)]), cuts, axis=0, dtype=np.float64)[::2]
            out[lo + np.flatnonzero(some)] += sums
        return out


def _grams(b: np.ndarray) -> np.ndarray:
    """Every four bytes in a row as one number."""
    b = b.astype(np.int64)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def shared_trees(spark, trees: ContextTrees, most: int = 1 << 30):
    """The trees on every executor, if they are not larger than that many bytes: their size
    follows languages and sampled texts (docs_per_lang), not the corpus."""
    if trees.nbytes > most:
        raise ValueError(f"the trees take {trees.nbytes} bytes, over {most}: learn from fewer texts a language")
    return spark.sparkContext.broadcast(trees)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", where: Column | None = None, docs_per_lang: int = 400, limits: bool = False) -> ContextTrees | None:
    """Trees from at most docs_per_lang whole texts of each language, those whose ids have
    the least hashes. Rows without a language or without an id teach nothing; rows that
    share an id all do if one of them was chosen. None where nothing is left to learn from.
    With limits, keep_identified also rejects texts whose code is far longer than that of
    the sample's own texts."""
    rows = docs.where(where) if where is not None else docs
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    named = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    frequent = named.groupBy("lang").agg(F.count("*").alias("n"))
    # a first cut by the hash leaves about eight times the documents wanted, so that the
    # ranks of a frequent language are few rows at any size of the corpus
    near = named.join(frequent, "lang").where(unit_hash("id") < 8 * docs_per_lang / F.col("n"))
    w = Window.partitionBy("lang").orderBy(unit_hash("id"), "id")
    chosen = near.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= docs_per_lang).select("id").distinct()
    if frequent.count() * docs_per_lang <= 1_000_000:  # ids at most; of more languages the join is left to Spark
        chosen = F.broadcast(chosen)
    sample = rows.join(chosen, rows[id_col] == chosen["id"]).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (unit_hash("id", F.lit("fold")) < 0.5).alias("fold"))
    if limits:
        return _with_limits(sample)
    by = _counts(sample.select("lang", "text"))
    return ContextTrees.build(by) if by else None


# fixed values: how far above the median of a language's own texts a text may lie (bits a
# byte, and deviations), bits that any text has besides, and the texts that a limit needs
MARGIN, DEVIATIONS, SLACK, TEXTS = 7.0, 6.0, 64.0, 20


def _counts(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language -> the four-byte grams of its texts, and their counts."""
    counts = sample.mapInArrow(_gram_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "n"))
    return {x: (gram[lang == x], n[lang == x]) for x in sorted(set(lang))}


def _within(limits: dict[str, float], lang: str, bits: str, text: Column) -> Column:
    """Whether a text's code is short enough for the language that codes it best."""
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col(lang)]
    size = F.greatest(F.lit(1), F.octet_length(text.cast("string")))
    return F.coalesce((F.col(bits) - limit) * size <= SLACK, F.lit(True))


def _with_limits(sample: DataFrame) -> ContextTrees | None:
    """Trees and limits. Trees of each half of the sample read the texts of the other half,
    so that no text is judged by what it taught; those beyond the limit teach nothing."""
    sample = cut(sample)
    halves = [_counts(sample.where(F.col("fold") == bool(k)).select("lang", "text")) for k in (0, 1)]
    limits: dict[str, float] = {}
    if all(halves):
        read = [_annotate(sample.where(F.col("fold") == bool(1 - k)), F.col("text"), ContextTrees.build(halves[k]), ["won", "score", "bits"]) for k in (0, 1)]
        read = read[0].unionByName(read[1])
        found: dict[str, list[float]] = {}
        # docs_per_lang rows a language at most
        for lang, bits in read.where("won <> 'und'").select("won", "bits").collect():
            found.setdefault(lang, []).append(bits)
        for lang, bits in found.items():
            if len(bits) >= TEXTS:
                middle = float(np.median(bits))
                limits[lang] = middle + max(MARGIN, DEVIATIONS * 1.4826 * float(np.median(np.abs(np.array(bits) - middle))))
        if limits:
            sample = read.where(_within(limits, "won", "bits", F.col("text")))
    by = _counts(sample.select("lang", "text"))
    if not by:
        return None
    trees = ContextTrees.build(by)
    trees.limits = limits
    return trees


def _scorer(shared, names: list[str]):
    """Appends the prediction to the rows; their last two columns are text and letter flag."""

    def run(batches):
        import pyarrow as pa

        trees = shared.value
        for batch in sliced(batches, 64):
            texts = [x.encode() if x else b"" for x in batch.columns[-2].to_pylist()]
            letters = np.array(batch.columns[-1].to_pylist(), bool)
            bits = trees.code_lengths(texts)
            best, least = bits.argmin(1), bits.min(1)
            score = 1 / np.exp2(least[:, None] - bits).sum(1)
            size = np.maximum(1, [len(t) for t in texts])
            pred = [trees.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
            made = [pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(least / size)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + made, names)

    return run


def _annotate(rows: DataFrame, text: Column, trees: ContextTrees | None, names: list[str]) -> DataFrame:
    """rows with the three prediction columns, under the given names."""
    if trees is None:
        return rows.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0), names[2]: F.lit(0.0)})
    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], DoubleType())])
    text = text.cast("string")
    fed = rows.select("*", text.alias(fresh("text_", rows.columns)), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(fresh("letter_", rows.columns)))
    shared = shared_trees(rows.sparkSession, trees)
    return fed.mapInArrow(_scorer(shared, schema.names), schema)


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for every row.

    score is the share of the winner among the languages' probabilities of the whole text
    (0 for ``und``). lang_pred is ``und`` where the text is null or has no letter; so is
    all where nothing could be learned. Ties go to the first language by name. Only the
    text is looked at; repeated rows stay, other columns do not matter, ids may be null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["lang_pred", "score", "bits_per_byte"]
    if trees is None:
        return _annotate(rows.select("doc_id"), F.lit(None), None, names)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    shared = shared_trees(docs.sparkSession, trees)
    return rows.select("doc_id", "text", letter).mapInArrow(_scorer(shared, ["doc_id", *names]), "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a language (not ``und``), with the columns as they come.

    With trees that have limits, a text whose best code passes the winner's limit (for its
    bytes, and some bits that any text has) is in no learned language and goes as well; a
    language with too few texts to learn a limit from takes all that it wins.
    """
    names = [fresh(n, docs.columns) for n in ("lang_pred", "lang_score", "lang_bits")]
    found = _annotate(docs, F.col(text_col), trees, names).where(F.col(names[0]) != "und")
    if trees is not None and trees.limits:
        found = found.where(_within(trees.limits, names[0], names[2], F.col(text_col)))
    return found.select(*docs.columns)
