"""Operators whose groups may be huge: equal to one window, without a task that holds a group."""

import hashlib
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import cascade, match, money, ranks, sampling, textq


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def skewed(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, rng.randint(0, 50), rng.random() * 1e6]), rng.randint(1, 9)) for k in range(n)]
    return spark.createDataFrame([(i, g, None if v is None else float(v), w) for i, g, v, w in rows], "id long, g string, v double, w long").repartition(5)


def test_prefix_sums_equal_a_window(spark):
    rows = skewed(spark)
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "id")
    want = rows.select("id", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("w").over(Window.partitionBy("g")).alias("t"))
    got = ranks.prefix_sums(rows, ["g"], [F.col("v").asc_nulls_first(), F.col("id")], F.col("w"))
    assert sorted(got.columns) == sorted([*rows.columns, "_before", "_total"])
    assert sorted(map(tuple, got.select("id", "_before", "_total").collect())) == sorted(map(tuple, want.collect()))
    whole = ranks.prefix_sums(rows, [], [F.col("id").desc()])
    assert {(r.id, r._before, r._total) for r in whole.collect()} == {(k, 3999 - k, 4000) for k in range(4000)}
    assert ranks.prefix_sums(rows.limit(0), ["g"], [F.col("id")]).count() == 0


def test_one_group_is_dealt_to_many_tasks(spark, monkeypatch):
    seen, settled = [], ranks.settled

    def spy(rows):
        out = settled(rows)
        seen.append([r["count"] for r in out.groupBy("_range").count().collect()])
        return out

    monkeypatch.setattr(ranks, "settled", spy)
    rows = spark.range(200_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 200_000 / 3).alias("v"))
    q = ranks.quantiles(rows, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).first().q
    assert np.allclose(q, np.quantile(np.arange(200_000) / 3, [0, 0.25, 0.5, 1]))
    assert len(seen[0]) == 4 and max(seen[0]) < 2 * 200_000 / 4


def test_quantiles_equal_numpy(spark):
    rows = skewed(spark)
    got = {r.g: r.q for r in ranks.quantiles(rows, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    by = {}
    for r in rows.collect():
        if r.v is not None:
            by.setdefault(r.g, []).append(r.v)
    assert set(got) == set(by)
    assert all(np.allclose(got[g], np.quantile(v, [0.1, 0.5, 0.9])) for g, v in by.items())


def test_even_spread_equals_two_windows(spark):
    rows = skewed(spark, 700)
    for quota in (1, 3, 20, 600):
        w = Window.partitionBy("g")
        n = rows.withColumn("rn", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count("*").over(w))
        n = n.withColumn("late", ((F.col("rn") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / quota)) != 0).cast("int"))
        want = n.withColumn("p", F.row_number().over(w.orderBy("late", "rn"))).where(F.col("p") <= quota)
        got = ranks.even_spread(rows, ["g"], [F.col("id")], quota)
        assert got.columns == rows.columns
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_concentration_has_no_window(spark):
    rows = skewed(spark).withColumn("code", F.col("id") % 60)
    df = money.concentration(rows, "code", {"w": F.col("w"), "v": F.col("v"), "none": F.lit(None).cast("double")}, (5, 20))
    assert "Window" not in plan(df)
    sums = {r.code: (float(r.w), r.v) for r in rows.groupBy("code").agg(F.sum("w").alias("w"), F.sum("v").alias("v")).collect()}
    first = sorted(sums, key=lambda c: (-sums[c][0], c))[:5]
    got = {(r.measure, r.ranked_by, r.top): r.share for r in df.collect()}
    assert len(got) == 18 and got["none", "w", 5] is None and got["w", "none", 5] is None
    assert abs(got["v", "w", 5] - 100 * sum(sums[c][1] or 0 for c in first) / sum(x[1] or 0 for x in sums.values())) < 1e-5


def test_grouping_sets_expand_cells_only(spark):
    rows = skewed(spark).withColumn("h", F.col("id") % 3)
    df = cascade.grouping_cascade(rows, ["g", "h"], [("known", F.col("v").isNotNull()), ("large", F.col("v") > 100)])
    text = plan(df)
    assert text.count("Expand") == 1 and text.index("Expand") < text.rindex("Aggregate")
    got = {(r.level, r.g, r.h): (r.n, r.known, r.large) for r in df.collect()}
    all_ = rows.collect()
    assert got["total", None, None] == (4000, sum(r.v is not None for r in all_), sum((r.v or 0) > 100 for r in all_))
    some = [r for r in all_ if r.g is None and r.h == 2]
    assert got["both", None, 2] == (len(some), sum(r.v is not None for r in some), sum((r.v or 0) > 100 for r in some))


def test_filler_patterns_with_and_without_an_anchor(spark):
    rows = spark.createDataFrame([("segun bases adjuntas del llamado",), ("un texto segun bases del llamado",), ("un texto con detalle interno",), ("corto",), (None,)], "t string")
    got = [r.f for r in rows.select(textq.is_filler(F.col("t"), 12, ["^segun bases", "^item$", "detalle interno"]).alias("f")).collect()]
    assert got == [True, False, True, True, True]


def test_bootstrap_equals_its_definition(spark):
    rows = [(f"k{k}", 0.5 + k % 7, k % 3 == 0) for k in range(60)] + [(None, 1.0, True), ("w", None, True)]
    df = spark.createDataFrame(rows, "k string, w double, y boolean").repartition(3)
    out = sampling.bootstrap(df, "k", F.col("y"), "w", 50, 9)
    assert "Generate" not in plan(out)
    edges, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        edges.append(total)
        p /= k + 1
    shares = []
    for b in range(50):
        a = t = 0.0
        for key, w, y in rows:
            if w is None:
                continue
            u = int(hashlib.md5("|".join(x for x in (key, str(b), "9") if x is not None).encode()).hexdigest()[:13], 16) / 2**52
            n = sum(u >= e for e in edges)
            a, t = a + n * w * y, t + n * w
        shares.append(100 * a / t)
    r = out.first()
    assert np.allclose([r.low, r.high], np.quantile(shares, [0.025, 0.975]), atol=1e-6)


def test_word_vectors_place_planted_synonyms_together(spark):
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        theme = k % 2
        context = [["mar", "ola", "sal", "pez"], ["nieve", "pico", "roca", "frio"]][theme]
        word = [["barco", "nave"], ["monte", "cerro"]][theme][rng.random() < 0.5]
        rows.append((k, [*rng.choices(context, k=3), word, *rng.choices(context, k=3)]))
    docs = spark.createDataFrame(rows, "id long, terms array<string>")
    model = match.word_vectors(docs, "terms", size=20)
    at = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    cos = lambda a, b: float(at[a] @ at[b] / np.linalg.norm(at[a]) / np.linalg.norm(at[b]))
    assert cos("barco", "nave") > cos("barco", "cerro") + 0.2 and cos("monte", "cerro") > cos("monte", "nave") + 0.2
    # texts are the means of their words, and siblings those of numpy over the exported vectors
    items = docs.where("id < 60").select("id", (F.col("id") % 3).alias("family"), "terms")
    cat = docs.where("id >= 60 and id < 160").select(F.col("id").alias("code"), (F.col("id") % 4).alias("family"), "terms")
    got = {r.id: r for r in match.best_sibling(match.embed(model, items), match.embed(model, cat), "id", "family", "vector", "code").collect()}
    mean = lambda terms: np.mean([at.get(t, np.zeros(20)) for t in terms], axis=0)
    for r in items.collect():
        u = mean(r.terms)
        sims = {c.code: float(u @ (v := mean(c.terms)) / np.linalg.norm(u) / np.linalg.norm(v)) for c in cat.collect() if c.family == r.family} if r.id < 6 else None
        if sims:
            assert abs(got[r.id].best_sim - max(sims.values())) < 1e-6 and sims[got[r.id].best_code] > max(sims.values()) - 1e-6


def test_sparse_siblings_salted_and_broadcast(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(rng.choices(words, k=4))
    docs = spark.createDataFrame([(k, rng.choice(["f1"] * 6 + ["f2", "f9", None]), text()) for k in range(300)], "id long, family string, txt string")
    cat = spark.createDataFrame([(f"c{k:03d}", rng.choice(["f1", "f1", "f2", None]), text()) for k in range(80)], "code string, family string, name string")
    cw, idf = match.tfidf(cat, "code", match.words(F.col("name")))
    dw, _ = match.tfidf(docs, "id", match.words(F.col("txt")), idf)
    sets = [{tuple(r) for r in match.best_sibling_terms(docs, dw, cat.select("code", "family"), cw, "id", "family", "code", most).collect()} for most in (10**6, 0)]
    near = lambda s: {(i, f, c, None if x is None else round(x, 7), no) for i, f, c, x, no in s}
    assert near(sets[0]) == near(sets[1]) and len(sets[0]) == 300
    d, c = {}, {}
    for r in dw.collect():
        d.setdefault(r.id, {})[r.term] = r.w
    for r in cw.collect():
        c.setdefault(r.code, {})[r.term] = r.w
    family = {r.code: r.family for r in cat.collect()}
    for i, f, code, sim, no in sets[0]:
        some = sorted((-round(sum(w * c.get(k, {}).get(t, 0) for t, w in d.get(i, {}).items()), 7), k) for k in family if f is not None and family[k] == f)
        assert no == (not some) and (code is None if not some else (abs(sim + some[0][0]) < 1e-6 and code == some[0][1]))
