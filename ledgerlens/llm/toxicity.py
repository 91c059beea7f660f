"""Toxicity from boosted trees over dense text features, with isotonic calibration.

A bounded sample of labelled documents teaches three things in turn: a lexicon (words and
word beginnings that are far more frequent in toxic texts, by the likelihood ratio), a
gradient-boosted tree ensemble over the features below, and an isotonic map from its
probability to a calibrated score. The map is learned on a fold the trees did not see.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, cut, fresh, sliced, unit_hash

FEATURES = [
    "log_words", "word_hits", "word_density", "stem_hits", "stem_density", "weight_density", "top_weight", "densest",
    "second_person", "near_second_person", "capitals", "shouted", "exclaims", "questions", "punctuation", "obfuscation", "masked_hits",
]

# fixed values: pronouns of the second person in the languages of the corpus
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya tu te toi ton ta tes vous votre vos "
    "du dich dir dein deine deinen deinem deiner ihr euch euer eure tú ti tus usted ustedes vosotros vuestro vuestra".split()
)
# fixed values: characters that stand for letters in masked words
LETTER_FOR = str.maketrans("0134578@$!|+€", "oieastbasiite")

STEMS = range(4, 8)
WINDOW = 20

_WORD = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!|+*€#.\-_]+[^\W\d_]|^[@$][^\W\d_]|^[\d@$]+[^\W\d_]+$")
_REPEAT = re.compile(r"(.)\1{2,}")


def keys(word: str) -> list[str]:
    """The lexicon entries that a lower-case word can match: itself, and its beginnings."""
    return ["=" + word, *(word[:k] for k in STEMS if k < len(word))]


def _counter(batches):
    import pyarrow as pa

    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            # once for each document, lest one text of repeats teach it
            seen[int(toxic)].update({k for w in set(_WORD.findall((text or "").lower())) for k in keys(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in (seen[1], seen[0]))], ["entry", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, entries: int = 3000, ratio: float = 4.0, least_g2: float = 25.0, least_docs: int = 4) -> dict[str, float]:
    """Entry -> log rate ratio, for entries that far more toxic texts hold (G2 statistic over
    numbers of documents); at most the given number of entries, those of the highest
    statistic, and of equal ones the first by name."""
    c = sample.mapInArrow(_counter, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    c = cut(c)
    a, b = (float(x or 0) for x in c.where(F.col("entry").startswith("=")).agg(F.sum("toxic"), F.sum("clean")).first())
    if not a or not b:
        return {}
    n = F.col("toxic") + F.col("clean")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
    g2 = 2 * (part(F.col("toxic"), a / (a + b)) + part(F.col("clean"), b / (a + b)))
    weight = F.log((F.col("toxic") + 0.5) / a) - F.log((F.col("clean") + 0.5) / b)
    best = c.where(F.col("toxic") >= least_docs).withColumns({"g2": g2, "weight": weight})
    best = best.where((F.col("g2") >= least_g2) & (F.col("weight") >= float(np.log(ratio)))).orderBy(F.desc("g2"), "entry").limit(entries)
    return {r.entry: r.weight for r in best.collect()}


class _Tokens(dict):
    """Token -> row of the table of what it adds to a document's features."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.rows = np.zeros((1 << 12, 12), np.float32)

    def match(self, word: str) -> tuple[int, int, float]:
        """Whether the word is in the lexicon, whether a beginning of it is, and the weight."""
        get = self.lexicon.get
        own, best, stem, n = get("=" + word), 0.0, 0, len(word)
        for k in STEMS:
            if k >= n:
                break
            w = get(word[:k])
            if w is not None:
                stem, best = 1, max(best, w)
        return int(own is not None), stem, best if own is None else max(best, own)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        upper = 0 if low == token else sum(map(str.isupper, token))
        masked = excl = quest = punct = 0
        if token.isalpha():
            parts, letters = (low,), len(token)
            hit, stem, weight = self.match(low)
            mixed, core = bool(_REPEAT.search(low)), low
        else:
            parts, letters = _WORD.findall(low), sum(map(str.isalpha, token))
            punct = len(token) - sum(map(str.isalnum, token))
            excl, quest = token.count("!"), token.count("?")
            hit = stem = 0
            weight = 0.0
            for p in parts:
                h, s, w = self.match(p)
                hit, stem, weight = hit + h, stem + (s and not h), max(weight, w)
            core = _EDGE.sub("", low)
            mixed = bool(_MIXED.search(low.rstrip(".,;:?!\"')"))) or bool(_REPEAT.search(core))
        if mixed and not hit and not stem:
            for plain in {re.sub(r"[^\w]|[\d_]", "", low.rstrip(".,;:?!\"')").translate(LETTER_FOR)), _REPEAT.sub(r"\1", core)}:
                h, s, w = self.match(plain)
                if h and plain not in parts:
                    masked, weight = 1, max(weight, w)
        stem = stem and not hit if len(parts) == 1 else stem
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = (hit, stem, weight, any(p in SECOND_PERSON for p in parts), letters, upper, letters > 1 and upper == letters, excl, quest, punct, mixed, masked)
        self[token] = k
        return k


def _near(mark: np.ndarray, other: np.ndarray, reach: int = 3) -> int:
    """How many marked places have one of the others within reach."""
    at, to = np.flatnonzero(mark), np.flatnonzero(other)
    if not len(at) or not len(to):
        return 0
    k = np.searchsorted(to, at)
    left = np.abs(at - to[np.maximum(k - 1, 0)])
    right = np.abs(to[np.minimum(k, len(to) - 1)] - at)
    return int((np.minimum(left, right) <= reach).sum())


def text_features(text: str | None, tokens: _Tokens) -> list[float]:
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    at = np.fromiter(map(tokens.__getitem__, words), np.int64, n)  # the table may grow meanwhile
    rows = tokens.rows[at]
    s = rows.sum(0, dtype=np.float64)
    hits = (rows[:, 0] + rows[:, 1] + rows[:, 11]) > 0
    densest = 0
    if hits.any():
        at = np.flatnonzero(hits)
        densest = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
    return [
        float(np.log1p(n)), s[0], 100 * s[0] / n, s[1], 100 * s[1] / n, s[2] / n, float(rows[:, 2].max()), float(densest),
        100 * s[3] / n, _near(hits, rows[:, 3] > 0) / max(1, int(hits.sum())), s[5] / max(1.0, s[4]), s[6] / n, s[7] / n, s[8] / n, s[9] / max(1.0, s[4] + s[9]), s[10] / n, s[11],
    ]


def _featurizer(shared, names: list[str], most: int = 200_000):
    """Appends the features to the rows; the text is their last column."""

    def run(batches):
        import pyarrow as pa

        tokens = _Tokens(shared.value)
        for batch in sliced(batches):
            made = []
            for x in batch.columns[-1]:
                if len(tokens) > most:
                    tokens = _Tokens(shared.value)
                made.append(text_features(x.as_py(), tokens))
            made = np.array(made, np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[:, k]) for k in range(made.shape[1]))], names)

    return run


def add_features(rows: DataFrame, text: Column, lexicon: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """rows with one double column per feature, and those columns' names."""
    names = []
    for f in FEATURES:
        names.append(fresh(f, rows.columns + names))
    schema = StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    # a lexicon has a bounded number of entries
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    return rows.select("*", text.cast("string").alias(fresh("text_", rows.columns))).mapInArrow(_featurizer(shared, schema.names), schema), names


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    isotonic: IsotonicRegressionModel | None
    base: float

    def score(self, rows: DataFrame, text: Column, into: str = "score") -> DataFrame:
        """rows with the calibrated score under the given name."""
        if self.trees is None:
            return rows.withColumn(into, F.lit(self.base))
        fed, names = add_features(rows, text, self.lexicon)
        vec, raw, prob, pred = (fresh(x, fed.columns) for x in ("vec", "raw", "prob", "pred"))
        trees = self.trees.copy({self.trees.featuresCol: vec, self.trees.rawPredictionCol: raw, self.trees.probabilityCol: prob, self.trees.predictionCol: pred})
        out = trees.transform(VectorAssembler(inputCols=names, outputCol=vec).transform(fed))
        out = out.withColumn(pred, vector_to_array(prob)[1])
        if self.isotonic is None:
            out = out.withColumn(into, F.col(pred))
        else:
            iso = self.isotonic.copy({self.isotonic.featuresCol: pred, self.isotonic.predictionCol: into})
            out = iso.transform(out).withColumn(into, F.least(F.lit(1.0), F.greatest(F.lit(0.0), into)))
        return out.select(*rows.columns, into)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, rounds: int = 24, depth: int = 4) -> ToxicityModel:
    """Learns from labelled documents whose crc32(id) mod 5 is not 0, at most ``sample`` of
    them (those whose ids have the least hashes). The fold 4 calibrates, the others teach
    lexicon and trees; equal texts of the sample count once, under their least id, and as
    toxic if one of them is. Several labels of a document count as toxic if one is. Without both
    classes the score is the share of toxic labels (0 without labels)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    known = known.where(crc_mod("id", 5) != 0)
    # a first cut by the hash leaves about four times the rows wanted, whatever their number
    known = known.where(unit_hash("id") * max(1, known.count()) < 4 * sample).orderBy(unit_hash("id"), "id").limit(sample)
    # ``sample`` short rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label"))
    # in one order, lest trees depend on how rows arrive
    rows = cut(rows.repartition(12, "id").sortWithinPartitions("id", "text"))
    calibrates = crc_mod("id", 5) == 4
    seen = {(r.c, r.label): r["count"] for r in rows.groupBy(calibrates.alias("c"), "label").count().collect()}
    total = sum(seen.values())
    base = sum(n for (_, y), n in seen.items() if y) / total if total else 0.0
    if not (seen.get((False, 0.0)) and seen.get((False, 1.0))):
        return ToxicityModel({}, None, None, base)
    lexicon = learn_lexicon(rows.where(~calibrates))
    fed, names = add_features(rows, F.col("text"), lexicon)
    fed = cut(VectorAssembler(inputCols=names, outputCol="features").transform(fed.withColumn("c", calibrates)).select("features", "label", "c"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=2, seed=7).fit(fed.where(~F.col("c")))
    isotonic = None
    if seen.get((True, 0.0)) and seen.get((True, 1.0)):
        p = trees.transform(fed.where("c")).select(vector_to_array("probability")[1].alias("p"), "label")
        isotonic = IsotonicRegression(featuresCol="p", labelCol="label").fit(p)
    return ToxicityModel(lexicon, trees, isotonic, base)


def classify(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; predicted is 1 from a score of 0.5.

    Only the whole text is looked at. Null and empty texts get the score of a text without
    words. Repeated rows stay, ids may be null, other columns do not matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return model.score(rows, F.col("text")).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows whose score is under 0.5, with the columns as they come."""
    into = fresh("score", docs.columns)
    return model.score(docs, F.col(text_col), into).where(F.col(into) < 0.5).select(*docs.columns)
