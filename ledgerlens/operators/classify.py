"""Supervised code classification from text: funnel, split, models, metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, IDF, RegexTokenizer, StopWordsRemover, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import settled


def label_funnel(rows: DataFrame, candidate: Column, broad: Column, strict: Column, guards: dict[str, Column]) -> DataFrame:
    """(step, name, n): candidates, broadly labelled, strictly labelled, and what is left
    after each guard, from one aggregate."""
    steps, holds = [], F.lit(True)
    for k, (name, c) in enumerate({"candidates": candidate, "broad": broad, "strict": strict, **guards}.items()):
        holds = holds & F.coalesce(c, F.lit(False))
        steps.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.count_if(holds).alias("n")))
    return rows.agg(F.array(*steps).alias("s")).select(F.inline("s"))


def split_by_year(rows: DataFrame, year: str, last_train: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training rows up to a year and test rows after it; too few of either is an error."""
    train, test = rows.where(F.col(year) <= last_train), rows.where(F.col(year) > last_train)
    n = rows.agg(F.count_if(F.col(year) <= last_train), F.count_if(F.col(year) > last_train)).first()
    if min(n) < least:
        raise ValueError(f"too few rows to train ({n[0]}) or to test ({n[1]})")
    return train, test


def text_pipeline(classifier: str, text: str, label: str, stop: list[str] = (), vocabulary: int = 20_000, least_docs: int = 5, least_chars: int = 2) -> Pipeline:
    """TF-IDF over words and a Naive Bayes or multinomial logistic regression classifier. Test
    rows of a label that training has not seen stay, and count as errors."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="frequencyDesc"),
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=" ", minTokenLength=least_chars),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stop)),
        CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=vocabulary, minDF=least_docs),
        IDF(inputCol="_tf", outputCol="_tfidf"),
    ]
    last = {"nb": NaiveBayes(featuresCol="_tfidf", labelCol="_label"), "lr": LogisticRegression(featuresCol="_tfidf", labelCol="_label", maxIter=20, regParam=0.01)}
    return Pipeline(stages=[*stages, last[classifier]])


def naive_bayes(
    train: DataFrame, test: DataFrame, key: str, label: str, terms: Column, vocabulary: int = 20_000, least_docs: int = 5, smoothing: float = 1.0, most: int = 5_000_000,
) -> DataFrame:
    """test with ``prediction``: multinomial Naive Bayes on TF-IDF, as aggregates and a join.

    The vocabulary are the most frequent terms of at least so many training texts (ties by
    name). A class scores the logarithm of its share, and for each term the text's weight
    times the logarithm of the term's share in the class. What a class has not seen gives a
    term that depends on the text's total weight only, so texts meet the classes that share a
    term with them, and the best of all classes by that common part alone; a class that shares
    terms never scores less than by that part. Ties go to the first label. Labels that
    training lacks are never predicted. ``key`` is unique in test; smoothing is at least one. The model's weights are
    counted, and broadcast up to ``most``.
    """
    if smoothing < 1:
        raise ValueError("smoothing has to be one or more")
    tf = train.select(key, F.col(label).alias("_y"), F.explode(terms).alias("term")).groupBy(key, "_y", "term").agg(F.count("*").alias("tf"))
    n = train.agg(F.count("*").alias("_n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_all")).where(F.col("df") >= least_docs).orderBy(F.desc("_all"), "term").limit(vocabulary)
    idf = settled(df.join(F.broadcast(n)).select("term", F.log((F.col("_n") + 1) / (F.col("df") + 1)).alias("idf")))
    # at most `vocabulary` rows
    sums = settled(tf.join(F.broadcast(idf), "term").groupBy("_y", "term").agg(F.sum(F.col("tf") * F.col("idf")).alias("_s")))
    size = idf.agg(F.count("*").alias("_v"))
    classes = train.groupBy(F.col(label).alias("_y")).agg(F.count("*").alias("_k")).join(sums.groupBy("_y").agg(F.sum("_s").alias("_t")), "_y", "left")
    k = classes.agg(F.count("*").alias("_c"))
    lam = F.lit(float(smoothing))
    share = F.log(F.col("_k") + lam) - F.log(F.col("_n") + lam * F.col("_c"))
    den = F.log(F.coalesce("_t", F.lit(0.0)) + lam * F.col("_v"))
    priors = settled(classes.join(F.broadcast(n)).join(F.broadcast(k)).join(F.broadcast(size)).select("_y", share.alias("_share"), den.alias("_den")))
    model = sums.select("_y", "term", (F.log(F.col("_s") + lam) - F.log(lam)).alias("_g"))
    model = F.broadcast(model) if sums.count() <= most else model
    w = test.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    total = w.groupBy(key).agg(F.sum("w").alias("_w"))
    common = lambda: F.col("_share") + F.coalesce("_w", F.lit(0.0)) * (F.log(lam) - F.col("_den"))
    met = w.join(model, "term").groupBy(key, "_y").agg(F.sum(F.col("w") * F.col("_g")).alias("_m")).join(F.broadcast(priors), "_y").join(total, key)
    met = met.groupBy(key).agg(F.min(F.struct((-F.round(common() + F.col("_m"), 9)).alias("far"), F.col("_y").alias("y"))).alias("_best"))
    lines = priors.agg(F.collect_list(F.struct("_y", "_share", "_den")).alias("_lines"))  # one row, one entry a class
    far = lambda c: -F.round(c["_share"] + F.coalesce("_w", F.lit(0.0)) * (F.log(lam) - c["_den"]), 9)
    out = test.join(total, key, "left").join(met, key, "left").join(F.broadcast(lines))
    plain = F.array_min(F.transform("_lines", lambda c: F.struct(far(c).alias("far"), c["_y"].alias("y"))))
    return out.withColumn("prediction", F.array_min(F.array_compact(F.array(F.col("_best"), plain)))["y"]).drop("_w", "_best", "_lines")


def confusion(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    return predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def metrics(counts: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """One row from (label, prediction, n): accuracy (per cent), macro F1 over the classes
    that are true or predicted anywhere, F1 weighted by support, classes, rows. An empty
    table gives zeros, or NULLs if ``empty`` is None."""
    t = counts.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("tp"), F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    per = t.groupBy("c").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    support = F.col("tp") + F.col("fn")
    g = per.agg(F.sum("tp").alias("tp"), F.sum(support).alias("n"), F.avg(f1).alias("macro"), F.sum(f1 * support).alias("w"), F.count("*").alias("k"))
    zero = lambda c: F.round(c if empty is None else F.coalesce(c, F.lit(empty)), 6)
    return g.select(zero(F.try_divide(100.0 * F.col("tp"), F.col("n"))).alias("accuracy_pct"), zero(F.col("macro")).alias("macro_f1"), zero(F.try_divide("w", "n")).alias("weighted_f1"), "k", F.col("n") if empty is None else F.coalesce("n", F.lit(int(empty))).alias("n"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent training class (ties to the first by name) and its share of
    the test rows in per cent; (NULL, 0) for an empty training set, a share of NULL without test rows."""
    best = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)
    one = best.agg(F.max(label).alias("majority"))  # one row even where there is no class
    classes = test.groupBy(F.col(label).alias("_y")).agg(F.count("*").alias("n")).join(F.broadcast(one), how="cross")
    hits = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_test"), F.sum(F.when(F.col("_y") == F.col("majority"), F.col("n")).otherwise(0)).alias("k"))
    return one.join(hits, how="cross").select("majority", "n_test", F.round(100 * F.try_divide("k", "n_test"), 6).alias("baseline_pct"))


def contamination(predictions: DataFrame, repeats: str, label: str, prediction: str, threshold: float = 0.02, empty: float | None = 0.0) -> DataFrame:
    """One row: macro F1 on all test rows and on those whose text is not repeated, and whether
    the two differ by no more than the threshold."""
    every = metrics(confusion(predictions, label, prediction), empty).select(F.col("macro_f1").alias("macro_f1_all"), F.col("n").alias("n_all"))
    single = metrics(confusion(predictions.where(F.col(repeats) == 1), label, prediction), empty).select(F.col("macro_f1").alias("macro_f1_single"), F.col("n").alias("n_single"))
    return every.join(single).withColumn("stable", F.abs(F.col("macro_f1_all") - F.col("macro_f1_single")) <= threshold)
