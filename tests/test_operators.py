"""Operators against hand-made cases and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import assoc, cascade, classify, codesets, link, match, ranks, sampling, series, snapshot, textq


def test_link_keeps_rows_and_blank_keys_link_to_nothing(spark):
    lines = spark.createDataFrame([("a",), (" A ",), ("b",), ("",), (None,)], "k string")
    keys = spark.createDataFrame([("A",), ("a",), ("",), (None,)], "key string")
    out = link.link(lines, keys, "k", "key")
    assert {r.k: r.linked for r in out.collect()} == {"a": True, " A ": True, "b": False, "": False, None: False}
    assert link.cardinality_kept(lines, out).first().kept


def test_exclusion_has_a_declared_null_policy(spark):
    rows = spark.createDataFrame([("x",), ("y",), (None,)], "m string")
    n = lambda c: rows.where(c).count()
    assert n(link.not_excluded(F.col("m"), ["x"])) == 1 and n(link.not_excluded(F.col("m"), ["x"], True)) == 2


def test_balanced_entities(spark):
    rows = spark.createDataFrame([(1, 2020), (1, 2021), (2, 2020), (1, 2021), (3, 2022)], "e int, y int")
    assert sorted(tuple(r) for r in link.in_all(rows, "e", "y", [2020, 2021]).collect()) == [(1, 2020), (1, 2021), (1, 2021)]


def test_digest_rank_equals_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("d")).withColumn("s", F.when(F.col("s") > 0, F.col("s")))
    out = ranks.digest_rank(rows, ["s"], "d", "r").withColumn("w", F.row_number().over(Window.partitionBy("s").orderBy("d")))
    assert out.count() == 3000 and out.where("r <> w").count() == 0


def test_average_rank_share(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "v double").withColumn("s", F.lit(1))
    got = {r.v: r.rank_share for r in ranks.average_rank_share(rows, ["s"], "v").collect()}
    assert got == {1.0: 0.25, 2.0: 0.625, 4.0: 1.0, None: None}


def test_weighted_median(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (10.0, 5.0)], "v double, w double")
    assert ranks.weighted_median(rows, "v", "w").first().weighted_median == 10.0


def test_agreement_of_code_sets(spark):
    a = spark.createDataFrame([("k", ["11112222", "33334444"]), ("m", ["11112222"]), ("z", [])], "key string, codes_a array<string>").withColumn("n_a", F.lit(1))
    b = spark.createDataFrame([("k", ["11119999"]), ("m", ["11112222"]), ("z", ["11112222"])], "key string, codes_b array<string>").withColumn("n_b", F.lit(1))
    got = {r.digits: r for r in codesets.agreement(codesets.paired(a, b, "key"), []).collect()}
    assert (got[4].n, got[4].overlap_pct, got[4].subset_pct, got[4].equal_pct) == (2, 100.0, 100.0, 50.0) and got[8].overlap_pct == 50.0


def test_permutation_pairs_everyone_once(spark):
    p = spark.range(500).select(F.col("id").alias("key"), F.lit("b").alias("bucket"), F.array(F.col("id").cast("string")).alias("codes_a"), F.array(F.col("id").cast("string")).alias("codes_b"))
    z = codesets.permuted(p, "key", ["bucket"], 1)
    r = z.agg(F.count("*").alias("n"), F.count_distinct("key").alias("k"), F.count_distinct("_other").alias("o"), F.count_if("self_pair").alias("s")).first()
    assert (r.n, r.k, r.o) == (500, 500, 500) and r.s < 10


def test_cascade_is_nested_and_nulls_fall_out(spark):
    rows = spark.createDataFrame([(1, 10.0), (None, 20.0), (5, 30.0)], "x int, a double")
    got = [(r.step, r.n, r.total) for r in cascade.cascade(rows, [("all", F.lit(True)), ("known", F.col("x").isNotNull()), ("big", F.col("x") > 2)], "a").collect()]
    assert got == [("all", 3, 60.0), ("known", 2, 40.0), ("big", 1, 30.0)]


def test_grouping_sets_tell_null_keys_from_totals(spark):
    rows = spark.createDataFrame([(2020, "a"), (2020, None)], "y int, m string")
    out = {(r.level, r.y, r.m): r.n for r in cascade.grouping_cascade(rows, ["y", "m"], [("all", F.lit(True))]).collect()}
    assert out == {("both", 2020, "a"): 1, ("both", 2020, None): 1, ("y", 2020, None): 2, ("m", None, "a"): 1, ("m", None, None): 1, ("total", None, None): 2}


def test_shift_share_parts_add_up(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.choice([1, 2]), rng.choice(["a", "b", None]), rng.random() < 0.4) for _ in range(500)], "y int, g string, c boolean")
    for r in series.shift_share(rows, "y", "g", F.col("c"), 1, 2).collect():
        assert r.composition + r.behaviour + r.interaction == pytest.approx(r.total, abs=1e-4)


CELLS = "s int, a long, b long, c long, d long"


def pooled(spark, strata):
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(strata)], CELLS).withColumn("predictor", F.lit("p"))
    return assoc.mantel_haenszel(rows).first()


def woolf(a, b, c, d):
    se = math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    o = a * d / (b * c)
    return round(o * math.exp(-1.959964 * se), 4), round(o * math.exp(1.959964 * se), 4)


def test_mantel_haenszel_one_stratum_is_woolf(spark):
    r = pooled(spark, [(40, 60, 30, 120)])
    assert r.pooled_or == 2.6667 and (r.low, r.high) == woolf(40, 60, 30, 120)
    r = pooled(spark, [(20, 130, 60, 90)])
    assert r.pooled_or == 0.2308 and (r.low, r.high) == woolf(20, 130, 60, 90)


def test_mantel_haenszel_edges(spark):
    assert pooled(spark, []) is None
    r = pooled(spark, [(2, 3, 2, 3), (40, 60, 30, 120)])
    assert (r.used, r.dropped, r.pooled_or) == (1, 1, 2.6667)
    r = pooled(spark, [(0, 0, 100, 100), (40, 60, 30, 120)])
    assert (r.used, r.dropped) == (1, 1)
    for t in ((0, 50, 50, 100), (50, 0, 50, 100)):
        assert pooled(spark, [t]).pooled_or is None
    r = pooled(spark, [(10, 10, 30, 20), (200, 50, 50, 10)])
    assert r.crude_or == 1.3125 and r.pooled_or < 1 and r.used == 2
    one, two = pooled(spark, [(40, 60, 30, 120)]), pooled(spark, [(40, 60, 30, 120)] * 2)
    assert one.pooled_or == two.pooled_or and two.high - two.low < one.high - one.low


@pytest.mark.parametrize(
    ("counts", "accuracy", "macro", "weighted"),
    [
        ([(0, 0, 50), (1, 1, 30), (2, 2, 20)], 100, 1, 1),
        ([(0, 1, 10), (1, 0, 10)], 0, 0, 0),
        ([(0, 0, 1)], 100, 1, 1),
        ([], 0, 0, 0),
    ],
)
def test_classification_metrics(spark, counts, accuracy, macro, weighted):
    r = classify.metrics(spark.createDataFrame(counts, "label int, prediction int, n long")).first()
    assert (r.accuracy_pct, r.macro_f1, r.weighted_f1) == (accuracy, macro, weighted)


def test_macro_f1_counts_rare_and_only_predicted_classes(spark):
    m = lambda c: classify.metrics(spark.createDataFrame(c, "label int, prediction int, n long")).first()
    r = m([(0, 0, 9000)] + [(i, 0, 100) for i in range(1, 11)])
    assert r.accuracy_pct == 90 and r.macro_f1 < 0.1 and r.weighted_f1 > 0.8
    assert m([(0, 0, 50), (1, 1, 40), (1, 9, 10)]).macro_f1 < m([(0, 0, 50), (1, 1, 50)]).macro_f1


def test_majority_baseline(spark):
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "y int")
    r = classify.majority_baseline(f([0, 0, 0, 1]), f([0, 0, 1, 1]), "y").first()
    assert (r.majority, r.baseline_pct) == (0, 50.0)
    r = classify.majority_baseline(f([]), f([0]), "y").first()
    assert (r.majority, r.baseline_pct) == (None, 0.0)


def test_texts_with_two_labels_are_discarded(spark):
    rows = spark.createDataFrame([("x", "11", 1), ("x", "11", 2), ("y", "11", 3), ("y", "22", 4), (None, "11", 5)], "t string, c string, i int")
    got = [tuple(r) for r in textq.dedup_texts(rows, "t", F.col("c"), ["i"]).collect()]
    assert got == [("x", "11", 2, 1)]


def test_leakage_guards(spark):
    rows = spark.createDataFrame([("clean text about chairs", "43211500", "wooden table"), ("wooden table", "43211500", "wooden table"), ("buy code 4321 now please", "43211500", "z" * 30), ("segun bases de licitacion", "43211500", "z" * 30), ("short", "43211500", "zz")], "t string, c string, n string")
    g = textq.trainable(F.col("t"), F.col("c"), F.col("n"))
    assert [tuple(r) for r in rows.select(*g.values()).collect()] == [(True, True, True, True), (False, True, True, True), (True, False, True, True), (True, True, False, True), (True, True, False, True)]


def snapshots(spark):
    rng = random.Random(11)
    spec = {2023: (400, 0, 5, 3, 0), 2024: (500, 0, 8, 9, 0), 2025: (300, 0, 120, 150, 0), 2026: (100, 7, 60, 20, 4)}
    a, b = [], []
    for y, (common, only1, only2, gain, lose) in spec.items():
        for k in range(common):
            had = k >= gain
            has = not (gain <= k < gain + lose)
            for _ in range(rng.choice((1, 2))):
                a.append((f"{y}-{k}", y, "d" if had else None))
                b.append((f"{y}-{k}", y, "d" if has else None))
        a += [(f"{y}-a{k}", y, "d") for k in range(only1)]
        b += [(f"{y}-b{k}", y, "d") for k in range(only2)]
    s = "key string, year int, awarded string"
    return spec, spark.createDataFrame(a, s), spark.createDataFrame(b, s)


def test_snapshot_diff_with_known_truth(spark):
    spec, a, b = snapshots(spark)
    one, two = (snapshot.consolidate(x, "key", ["awarded", "year"]) for x in (a, b))
    d = snapshot.diff(one, two, "key", {"awarded": "awarded"}).withColumn("year", F.substring("key", 1, 4).cast("int"))
    got = {(r.year, r.metric): r.value for r in snapshot.diff_metrics(d, "year", ["awarded"]).collect()}
    for y, (common, only1, only2, gain, lose) in spec.items():
        assert [got[y, m] for m in ("common", "only_old", "only_new", "gained_awarded", "lost_awarded")] == [common, only1, only2, gain, lose]


def test_order_statistics_of_lags(spark):
    rows = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 5)], "g string, d int")
    got = {r.g: (r.lag_n, r.lag_median, r.lag_p90, r.lag_max) for r in snapshot.lag_quantiles(rows, ["g"], F.col("d")).collect()}
    assert got == {"a": (10, 5, 9, 9), "b": (1, 5, 5, 5)}


def test_duplicate_factor_counts_null_keys(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", "x")], "p int, k string, j string")
    assert snapshot.duplicate_factor(rows, "p", ["k", "j"]).first().factor == 1.5


def test_bottom_k_does_not_depend_on_row_order(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("s"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = sampling.bottom_k(rows, ["s"], "h", 50, ["id"])
    two = sampling.bottom_k(rows.repartition(5, F.rand(1)), ["s"], "h", 50, ["id"])
    assert one.count() == 49 and link.same_selection(one, two, "id").first().equal


def test_bootstrap_holds_the_estimate(spark):
    rows = spark.range(400).select("id", F.lit(1.0).alias("w"), (F.col("id") % 4 == 0).alias("y"))
    r = sampling.bootstrap(rows, "id", F.col("y"), "w", 200).first()
    assert r.estimate == 25.0 and r.low < 25.0 < r.high and r.high - r.low < 15


def test_exact_mcnemar(spark):
    f = lambda b, c: assoc.mcnemar_exact(spark.createDataFrame([(b, c)], "first_only long, second_only long")).first().p
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    for b, c in ((0, 0), (1, 9), (10, 12), (70, 30)):
        assert f(b, c) == pytest.approx(exact(b, c) if b + c else 1.0, abs=1e-6)


def test_best_sibling_keeps_items_without_a_family(spark):
    items = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 9, [1.0, 0.0]), (3, 1, [0.0, 0.0])], "id int, f int, v array<double>")
    cat = spark.createDataFrame([("b", 1, [2.0, 0.0]), ("a", 1, [3.0, 0.0])], "code string, f int, v array<double>")
    got = {r.id: (r.best_code, r.no_family) for r in match.best_sibling(items, cat, "id", "f", "v", "code").collect()}
    assert got == {1: ("a", False), 2: (None, True), 3: ("a", False)}


def test_metrics_of_no_rows_can_be_null(spark):
    none = spark.createDataFrame([], "label int, prediction int, n long")
    r = classify.metrics(none, None).first()
    assert (r.accuracy_pct, r.macro_f1, r.weighted_f1, r.k, r.n) == (None, None, None, 0, None)
    r = classify.contamination(spark.createDataFrame([], "r long, y int, p int"), "r", "y", "p", empty=None).first()
    assert (r.macro_f1_all, r.n_all, r.stable) == (None, None, None)


def test_majority_baseline_without_test_rows_is_one_row(spark):
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "y int")
    r = classify.majority_baseline(f([1, 1, 0]), f([]), "y").collect()
    assert [tuple(x) for x in r] == [(1, 0, None)]


def test_design_fit_where_every_stratum_is_certain(spark):
    from ledgerlens.operators import sampling

    f = lambda n, k: sampling.design_fit(spark.createDataFrame([(1.0,)] * n, "pi double"), k).first()
    assert f(18, 12).z == float("-inf") and f(3, 12).z == float("inf") and f(12, 12).z != f(12, 12).z and f(18, 12).sd == 0


def test_doc_reconciliation_joins_lines_once(spark):
    from ledgerlens.operators import money
    from ledgerlens.plans import q_money

    rows = spark.createDataFrame([(1, 10, 30, "b"), (1, 20, 30, "a"), (2, 5, 4, None)], "doc long, amount long, declared long, mechanism string")
    got = money.reconcile_documents(rows, "doc", "amount", "declared", more=(F.min("mechanism").alias("first"),)).orderBy("doc").collect()
    assert [(r.ratio, r.outside, r.first) for r in got] == [(1.0, False, "a"), (1.25, True, None)]
    plan = q_money.doc_reconciliation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
