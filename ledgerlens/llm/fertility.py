"""Quality rules from tokeniser fertility.

Public subword vocabularies read every word of a text. One with byte fallback gives three
figures: characters per token (low where the vocabulary does not know the language or the
text is noise), the share of tokens that are single fallback bytes, and the entropy of the
text's tokens as a share of the most that so many tokens can have (low where a text repeats
itself). A second, byte-level one of many languages gives its characters per token as well.
Rejection bands are learned for each group (language, or script where a table has no
language) and size of text from all documents: quartiles widened by a multiple of their
distance. Quartiles are exact: rates are rounded to thousandths, counted, and the counts
are summed up, so neither order nor partitions matter, and a group of any size is a short
histogram. Plain counts of words, symbols and repeats come beside it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import cut, fresh, sliced

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
RATES = ["chars_per_token", "byte_share", "token_entropy", "chars_per_token_multi"]
#: A second vocabulary: the ranks of a byte-level BPE (base64 token and rank a line), and its split pattern.
Ranks = tuple[bytes, str]


class _Words(dict):
    """Word -> number; the tokens of word k are tokens[start[k]:start[k + 1]], and second[k]
    is how many it has in the second vocabulary."""

    def __init__(self, model, second=None) -> None:
        self.model, self.encode = model, second
        self.start = np.zeros(1 << 12, np.int64)
        self.second = np.zeros(1 << 12, np.int32)
        self.tokens = np.zeros(1 << 14, np.int32)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.get, found, itertools.repeat(-1)), np.int64, len(found))
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            missed = [found[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(missed)))
            out[unknown] = np.fromiter(map(self.__getitem__, missed), np.int64, len(missed))
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Words that are not known yet, all at once."""
        joined = b" ".join(new).decode()
        texts = joined.split(" ")
        ids = self.model.encode(texts, num_threads=1)
        k, n = len(self), len(new)
        ends = self.start[k] + np.cumsum(np.fromiter(map(len, ids), np.int64, n))
        self.start, self.second = _longer(self.start, k + n + 1), _longer(self.second, k + n)
        self.tokens = _longer(self.tokens, int(ends[-1]))
        self.tokens[self.start[k] : ends[-1]] = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(ends[-1] - self.start[k]))
        self.start[k + 1 : k + n + 1] = ends
        if self.encode:
            self.second[k : k + n] = self.encode(texts, joined)
        self.update(zip(new, range(k, k + n), strict=True))


def _longer(values: np.ndarray, least: int) -> np.ndarray:
    """The values with room for as many at least; room is doubled."""
    size = len(values)
    while size < least:
        size *= 2
    return values if size == len(values) else np.concatenate([values, np.zeros(size - len(values), values.dtype)])


def repeated_words(words: np.ndarray, size: int = 8) -> int:
    """How many words lie in a window of ``size`` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    mixed = words.astype(np.uint64)
    mixed = (mixed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + mixed[k : k + n]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + size, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + size] -= 1
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines (split at line feeds) with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measures(text: str, ids: np.ndarray, words: _Words, is_byte: np.ndarray) -> list[float]:
    """Of a text whose words have these numbers."""
    n = len(ids)
    chars = len(text) - sum(map(text.count, SPACES))
    counts = [n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text) if "\n" in text else 0, repeated_words(ids)]
    start, stop = words.start[ids], words.start[ids + 1]
    size = stop - start
    total = int(size.sum())
    if not total:
        return [*counts, 0, 0.0, 0.0, 0.0, 0.0]
    tokens = words.tokens[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)]
    each = np.unique(tokens, return_counts=True)[1] / total
    entropy = float(-(each * np.log2(each)).sum())
    multi = chars / max(1, int(words.second[ids].sum())) if words.encode else 0.0
    return [*counts, total, chars / total, float(is_byte[tokens].mean()), entropy / np.log2(total) if total > 1 else 1.0, multi]


def all_measures(texts: Iterable[str | None], fresh_words: Callable[[], _Words], words: _Words, is_byte: np.ndarray, most: int, step: int = 1 << 15) -> tuple[list[list[float]], _Words]:
    """Measures of each text, and the words known by then. Words are looked up for some texts
    together, until there are ``step``; beyond ``most`` known words a new table begins."""
    made, some, found, ends = [], [], [], []

    def flush() -> None:
        nonlocal words
        if len(words) > most:
            words = fresh_words()
        ids, a = words.numbers(found), 0
        for text, b in zip(some, ends, strict=True):
            made.append(measures(text, ids[a:b], words, is_byte))
            a = b
        some.clear(), found.clear(), ends.clear()

    for text in texts:
        text = text or ""
        some.append(text)
        found += text.encode().split()
        ends.append(len(found))
        if len(found) >= step:
            flush()
    flush()
    return made, words


def second_encoder(ranks: Ranks | None):
    """Encodes one text."""
    if ranks is None:
        return None
    import base64

    import tiktoken

    merges = {base64.b64decode(t): int(n) for t, n in map(bytes.split, ranks[0].splitlines())}
    return tiktoken.Encoding("second", pat_str=ranks[1], mergeable_ranks=merges, special_tokens={}).encode_ordinary


def second_sizes(ranks: Ranks | None):
    """Counts the tokens of each of many words, given the words and the words joined by
    blanks. A blank before other characters begins a pre-token of the byte-level scheme, so
    the words are encoded at once, and their first tokens are those that begin with a blank.
    White space inside a word could be taken together with the blank: then each is encoded
    by itself."""
    if ranks is None:
        return None
    import base64

    encode = second_encoder(ranks)
    merges = {int(n): base64.b64decode(t) for t, n in map(bytes.split, ranks[0].splitlines())}
    first = np.zeros(max(merges) + 1, bool)
    first[[n for n, t in merges.items() if t.startswith(b" ")]] = True

    def sizes(texts: list[str], joined: str) -> np.ndarray:
        if len(joined.split()) == len(texts):
            ids = np.array(encode(" " + joined), np.int64)
            at = np.flatnonzero(first[ids])
            if len(at) == len(texts):
                return np.diff(at, append=len(ids))
        return np.array([len(encode(" " + x)) for x in texts], np.int64)

    return sizes


def _measurer(shared, names: list[str], most: int = 200_000):
    """Appends the measures to the rows; the text is their last column."""

    def run(batches):
        import pyarrow as pa
        import sentencepiece

        proto, ranks = shared.value
        model, second = sentencepiece.SentencePieceProcessor(model_proto=proto), second_sizes(ranks)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        words = _Words(model, second)
        for batch in sliced(batches):
            made, words = all_measures((x.as_py() for x in batch.columns[-1]), lambda: _Words(model, second), words, is_byte, most)
            cols = np.array(made, np.float64).reshape(-1, len(COUNTS) + len(RATES))
            new = [pa.array(cols[:, k].astype(np.int64)) if k < len(COUNTS) else pa.array(cols[:, k]) for k in range(cols.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    return run


def script(text: Column) -> Column:
    """The script of a text's first letter, a group for bands where no language is known."""
    first = F.regexp_extract(text, r"\p{L}", 0)
    known = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]
    out = F.when(first == "", "none")
    for s in known:
        out = out.when(first.rlike(rf"\p{{Is{s}}}"), s.lower())
    return F.coalesce(out.otherwise("other"), F.lit("none"))


def measured(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None, ranks: Ranks | None = None) -> DataFrame:
    """(doc_id, group_key, counts and rates) for every row."""
    key = F.coalesce(group.cast("string"), F.lit("none")) if group is not None else script(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("group_key"), F.col(text_col).cast("string").alias("text_"))
    schema = StructType([*rows.schema.fields[:2], *(StructField(c, LongType()) for c in COUNTS), *(StructField(c, DoubleType()) for c in RATES)])
    # a vocabulary file's size does not depend on the data
    shared = docs.sparkSession.sparkContext.broadcast((model, ranks))
    return rows.mapInArrow(_measurer(shared, schema.names), schema)


def size_class(tokens: Column) -> Column:
    """Texts whose token counts lie between the same powers of two: rates vary with length."""
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def quartiles(measures: DataFrame) -> DataFrame:
    """(level, group_key, size_class, docs, and low_ and high_ of each rate): the least
    values, in thousandths, that a quarter and three quarters of the documents do not pass;
    for each group and size (level 0), each group (1), and all documents (3)."""
    each = F.array(*(F.struct(F.lit(r).alias("rate"), F.round(F.col(r) * 1000).cast("long").alias("value")) for r in RATES))
    finest = cut(measures.select("group_key", "size_class", F.inline(each)).groupBy("group_key", "size_class", "rate", "value").agg(F.count("*").alias("n")))
    sums = lambda *by: finest.groupBy(*by, "rate", "value").agg(F.sum("n").alias("n"))
    none = {"group_key": F.lit(None).cast("string"), "size_class": F.lit(None).cast("int")}
    levels = finest.withColumn("level", F.lit(0))
    levels = levels.unionByName(sums("group_key").withColumns({"level": F.lit(1), "size_class": none["size_class"]}))
    levels = levels.unionByName(sums().withColumns({"level": F.lit(3), **none}))
    by = ["level", "group_key", "size_class"]
    # a partition is a histogram of a rate: some thousand values, however many documents
    w = Window.partitionBy(*by, "rate")
    upto = F.sum("n").over(w.orderBy("value"))
    at = levels.withColumns({"upto": upto, "docs": F.sum("n").over(w)})
    of = lambda r, part: F.min(F.when((F.col("rate") == r) & (F.col("upto") >= part * F.col("docs")), F.col("value"))) / 1000
    return at.groupBy(*by).agg(F.max("docs").alias("docs"), *(of(r, p).alias(f"{name}_{r}") for r in RATES for name, p in (("low", 0.25), ("high", 0.75))))


# fixed values: the least distance of quartiles that a band is widened by
FLOOR = {"chars_per_token": 0.03, "byte_share": 0.01, "token_entropy": 0.015, "chars_per_token_multi": 0.03}


def bands(measures: DataFrame, width: float = 4.0, least_words: int = 20, least_docs: int = 50) -> DataFrame:
    """(level, group_key, size_class, band): the quartiles of each rate over all documents
    with enough words, widened by ``width`` times their distance (and a floor for it).
    Classes of few documents are left out: they have their group's band, or that of all."""
    some = measures.where(F.col("n_words") >= least_words).withColumn("size_class", size_class(F.col("n_tokens")))
    q = quartiles(some)
    wide = {r: F.greatest(F.col(f"high_{r}") - F.col(f"low_{r}"), F.lit(FLOOR[r])) * width for r in RATES}
    return q.where(F.col("docs") >= least_docs).select(
        "level",
        "group_key",
        "size_class",
        F.struct(
            *((F.col(f"low_{r}") - wide[r]).alias(f"low_{r}") for r in RATES if r != "byte_share"),
            *((F.col(f"high_{r}") + wide[r]).alias(f"high_{r}") for r in RATES if r != "token_entropy"),
        ).alias("band"),
    )


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    """Too few words, or too many of them in repeated windows (per cent)."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def judge(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None, ranks: Ranks | None = None, max_groups: int = 10_000) -> DataFrame:
    """Every row's id, counts, rates, base_failed and kept.

    kept is false where base_failed, or where a rate lies outside the band of its group and
    size; a class of too few documents has its group's band, and a small group that of all.
    A tie with a band's limit is inside. Null texts count as empty (no words, so base_failed). Without any band rows pass the
    method. Repeated rows stay, ids and groups may be null, other columns do not matter.
    """
    m = cut(measured(docs, model, id_col, text_col, group, ranks))
    limits = cut(bands(m))
    # a band is six values; where there are very many groups the join is left to Spark
    small = F.broadcast if limits.count() <= max_groups else lambda df: df
    by = [limits.where(F.col("level") == k).drop("level").withColumnRenamed("band", f"band{k}") for k in (0, 1, 3)]
    sized = m.withColumn("size_class", size_class(F.col("n_tokens"))).withColumn("one", F.lit(1))
    sized = sized.join(small(by[0]), ["group_key", "size_class"], "left").join(small(by[1].drop("size_class")), "group_key", "left")
    sized = sized.join(F.broadcast(by[2].select("band3", F.lit(1).alias("one"))), "one", "left")
    band = F.coalesce("band0", "band1", "band3")
    inside = F.lit(True)
    for r in RATES:
        if r != "byte_share":
            inside = inside & (F.col(r) >= band[f"low_{r}"])
        if r != "token_entropy":
            inside = inside & (F.col(r) <= band[f"high_{r}"])
    out = sized.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return out.select("doc_id", *COUNTS[:-1], "base_failed", "kept", COUNTS[-1], *RATES)


def keep_good(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None, ranks: Ranks | None = None) -> DataFrame:
    """The rows that judge keeps, with the columns as they come. Rows that share an id are
    kept if one of them is; rows without an id go."""
    keep = fresh("keep", docs.columns)
    good = judge(docs, model, id_col, text_col, group, ranks).where("kept").select(F.col("doc_id").alias(keep)).distinct()
    return docs.join(good, F.col(id_col) == F.col(keep), "left_semi")
