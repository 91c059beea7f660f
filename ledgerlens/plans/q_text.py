"""Queries of text evaluability, matching and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import cascade as K
from ..operators import classify as Y
from ..operators import latent as A
from ..operators import match as M
from ..operators import textq as T
from ..sources.sinks import settled
from .q_clean import _NORM
from .registry import query
from .standin import TEXTS, code8, table, texts

_FILLER = "|".join(T.FILLER)
_LINES = f"""t AS (SELECT *, {_NORM} AS txt, 'item ' || substr(code, 1, 4) AS name FROM ({TEXTS})),
f AS (SELECT *, txt IS NOT NULL AS has_text, coalesce(length(txt) < 12 OR regexp_matches(txt, '{_FILLER}'), true) AS filler, coalesce(contains(txt, name) OR contains(name, txt), false) AS circular,
  coalesce(contains(txt, code) OR contains(txt, substr(code, 1, 6)) OR contains(txt, substr(code, 1, 4)), false) AS written FROM t)"""


def lines(spark, sf_dir):
    """Lines with their normalised text. It is exploded from an array of one, since conditions
    are moved below a plain projection, each with a copy of the whole normalisation."""
    d = texts(spark, sf_dir)
    return d.withColumn("txt", F.explode(F.array(C.norm_text(F.col("text"))))).withColumn("name", F.concat(F.lit("item "), F.substring("code", 1, 4)))


def _rungs():
    t, n = F.col("txt"), F.col("name")
    return [("has_text", t.isNotNull()), ("not_filler", ~T.is_filler(t)), ("evaluable", ~T.is_circular(t, n))]


_RUNGS = "CAST(count(*) FILTER (WHERE has_text) AS BIGINT) AS has_text, CAST(count(*) FILTER (WHERE has_text AND NOT filler) AS BIGINT) AS not_filler, CAST(count(*) FILTER (WHERE has_text AND NOT filler AND NOT circular) AS BIGINT) AS evaluable"


@query(f"""WITH {_LINES} SELECT year, mechanism, count(*) AS n, {_RUNGS}, CASE grouping(year, mechanism) WHEN 0 THEN 'both' WHEN 1 THEN 'year' WHEN 2 THEN 'mechanism' ELSE 'total' END AS level FROM f GROUP BY GROUPING SETS ((year, mechanism), (year), (mechanism), ())""")
def text_cascade_grouping_sets(spark, sf_dir):
    """The evaluability cascade at every level, in one pass."""
    return K.grouping_cascade(lines(spark, sf_dir), ["year", "mechanism"], _rungs())


@query(f"WITH {_LINES} SELECT md5(txt) AS txt, count(*) AS n, bool_and(filler) AS caught FROM f WHERE txt IS NOT NULL GROUP BY f.txt ORDER BY n DESC, f.txt LIMIT 40")
def filler_frequency(spark, sf_dir):
    """The most repeated texts and whether the filler rule catches them."""
    return T.frequent_texts(lines(spark, sf_dir), "txt").withColumn("txt", F.md5(F.col("txt").cast("binary")))


@query(f"WITH {_LINES} SELECT year, mechanism, count(*) AS n, round(100.0 * count(*) FILTER (WHERE circular) / count(*), 6) AS circular_pct, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY year), 6) AS weight_pct FROM f GROUP BY year, mechanism")
def circularity_by_mechanism(spark, sf_dir):
    """Circular texts and weight of each mechanism in a year."""
    return T.circularity(lines(spark, sf_dir), "year", "mechanism", T.is_circular(F.col("txt"), F.col("name")))


@query(f"WITH {_LINES}, p AS (SELECT txt, code, count(*) AS n FROM f WHERE txt IS NOT NULL GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_pairs, true AS approx_ok, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS factor FROM p")
def distinct_text_code_pairs(spark, sf_dir):
    """Distinct (text, code) pairs; the sketch has to lie within 10 per cent."""
    p = T.distinct_pairs(lines(spark, sf_dir), "txt", "code")
    return p.select("n_rows", "n_pairs", (F.abs(F.col("approx_pairs") - F.col("n_pairs")) <= 0.1 * F.col("n_pairs")).alias("approx_ok"), "factor")


@query(f"""WITH {_LINES} SELECT * FROM (
SELECT 0 AS step, 'candidates' AS name, count(*) FILTER (WHERE has_text) AS n FROM f UNION ALL SELECT 1, 'broad', count(*) FILTER (WHERE has_text AND id % 5 <> 0) FROM f UNION ALL SELECT 2, 'strict', count(*) FILTER (WHERE has_text AND id % 5 <> 0 AND id % 7 <> 0) FROM f
UNION ALL SELECT 3, 'not_circular', count(*) FILTER (WHERE has_text AND id % 5 <> 0 AND id % 7 <> 0 AND NOT circular) FROM f UNION ALL SELECT 4, 'code_not_written', count(*) FILTER (WHERE has_text AND id % 5 <> 0 AND id % 7 <> 0 AND NOT circular AND NOT written) FROM f
UNION ALL SELECT 5, 'not_filler', count(*) FILTER (WHERE has_text AND id % 5 <> 0 AND id % 7 <> 0 AND NOT circular AND NOT written AND NOT filler) FROM f
UNION ALL SELECT 6, 'enough_tokens', count(*) FILTER (WHERE has_text AND id % 5 <> 0 AND id % 7 <> 0 AND NOT circular AND NOT written AND NOT filler AND len(string_split(txt, ' ')) >= 3) FROM f)""")
def label_funnel(spark, sf_dir):
    """Labels broad and strict, and what each leakage guard leaves."""
    c = F.col
    return Y.label_funnel(lines(spark, sf_dir), c("txt").isNotNull(), c("id") % 5 != 0, c("id") % 7 != 0, T.trainable(c("txt"), c("code"), c("name"), 3))


@query(f"""WITH {_LINES}, g AS (SELECT txt, min(substr(code, 1, 2)) AS a, max(substr(code, 1, 2)) AS b, count(*) AS n_repeats, min(year) AS year FROM f WHERE txt IS NOT NULL GROUP BY txt)
SELECT a AS label, n_repeats, year, count(*) AS n_texts FROM g WHERE a = b GROUP BY 1, 2, 3""")
def text_dedup(spark, sf_dir):
    """One row a text, where it has one label."""
    d = T.dedup_texts(lines(spark, sf_dir), "txt", F.substring("code", 1, 2), ["year"])
    return d.groupBy("label", "n_repeats", "year").agg(F.count("*").alias("n_texts"))


def dataset(spark, sf_dir):
    """One row a text with its language as the class."""
    return T.dedup_texts(lines(spark, sf_dir).where(~T.is_filler(F.col("txt"))), "txt", F.col("label"), ["year", "id"])


_DATA = f"""{_LINES}, d AS (SELECT txt, min(label) AS label, max(label) AS other, count(*) AS n_repeats, min(year) AS year, min(id) AS id FROM f WHERE NOT filler AND label IS NOT NULL GROUP BY txt),
s AS (SELECT * FROM d WHERE label = other)"""


@query(f"""WITH {_DATA}, b AS (SELECT label FROM s WHERE year <= 2021 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT (SELECT label FROM b) AS majority, count(*) AS n_test, round(100.0 * avg(CASE WHEN label = (SELECT label FROM b) THEN 1 ELSE 0 END), 6) AS baseline_pct FROM s WHERE year > 2021""")
def majority_baseline(spark, sf_dir):
    """The majority class of the training years, on the years after."""
    train, test = Y.split_by_year(settled(dataset(spark, sf_dir).select("label", "year")), "year", 2021, 0)
    return Y.majority_baseline(train, test, "label")


@query(f"""WITH {_DATA}, p AS (SELECT label, CASE WHEN id % 7 = 0 THEN 'xx' WHEN id % 5 = 0 THEN 'en' ELSE label END AS prediction FROM s), c AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2),
k AS (SELECT label AS c FROM c UNION SELECT prediction FROM c), m AS (SELECT k.c, coalesce(sum(n) FILTER (WHERE label = k.c AND prediction = k.c), 0) AS tp, coalesce(sum(n) FILTER (WHERE label <> k.c AND prediction = k.c), 0) AS fp, coalesce(sum(n) FILTER (WHERE label = k.c AND prediction <> k.c), 0) AS fn FROM k, c GROUP BY k.c),
f1 AS (SELECT *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM m)
SELECT round(100.0 * sum(tp) / sum(tp + fn), 6) AS accuracy_pct, round(avg(coalesce(f, 0)), 6) AS macro_f1, round(sum(coalesce(f, 0) * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1, count(*) AS k, CAST(sum(tp + fn) AS BIGINT) AS n FROM f1""")
def classification_metrics(spark, sf_dir):
    """Accuracy and F1 from label and prediction counts, with a class only predicted."""
    d = dataset(spark, sf_dir)
    p = F.when(F.col("id") % 7 == 0, "xx").when(F.col("id") % 5 == 0, "en").otherwise(F.col("label"))
    return Y.metrics(Y.confusion(d.select("label", p.alias("prediction")), "label", "prediction"))


def _norm_sql(*columns):
    return f"trim(regexp_replace(regexp_replace(lower(concat_ws(' ', {', '.join(columns)})), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def coded_texts(spark, sf_dir, digits):
    """Part texts with the code prefix of what they name, one row a text: brand gives two
    digits, type two more, some are wrong, and some later ones are of a code never seen."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    brand, kind = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long"), F.ascii("p_type")
    code = F.concat(F.lpad(F.when(k % 11 == 0, k % 25 + 10).otherwise(brand + 10).cast("string"), 2, "0"), F.lpad(kind.cast("string"), 2, "0"), F.lpad((k % 10000).cast("string"), 4, "0"))
    year = (F.lit(2017) + k % 8).cast("int")
    text = C.norm_text(F.concat_ws(" ", F.lit("para"), F.replace("p_brand", F.lit("#"), F.lit("n")), "p_name", "p_type", F.when(k % 4 == 0, F.lit("de acero"))))
    rows = p.select(k.alias("id"), text.alias("txt"), year.alias("year"), F.substring(F.when((k % 41 == 0) & (year > 2021), F.lit("99990000")).otherwise(code), 1, digits).alias("label"))
    return T.dedup_texts(rows, "txt", F.col("label"), ["year", "id"])


def _coded_sql(digits):
    text = _norm_sql("'para'", "replace(p_brand, '#', 'n')", "p_name", "p_type", "CASE WHEN p_partkey % 4 = 0 THEN 'de acero' END")
    code = "lpad(CAST(CASE WHEN p_partkey % 11 = 0 THEN p_partkey % 25 + 10 ELSE CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) + 10 END AS VARCHAR), 2, '0') || lpad(CAST(ascii(p_type) AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')"
    stop = ", ".join(f"'{w}'" for w in M.STOP)
    return f"""r AS (SELECT p_partkey AS id, {text} AS txt, 2017 + p_partkey % 8 AS year, substr(CASE WHEN p_partkey % 41 = 0 AND 2017 + p_partkey % 8 > 2021 THEN '99990000' ELSE {code} END, 1, {digits}) AS label FROM part),
s AS MATERIALIZED (SELECT txt, min(label) AS label, count(*) AS n_repeats, min(year) AS year, min(id) AS id FROM r GROUP BY txt HAVING min(label) = max(label)), train AS (SELECT * FROM s WHERE year <= 2021), test AS (SELECT * FROM s WHERE year > 2021),
words AS MATERIALIZED (SELECT txt, label, year, term, count(*) AS tf FROM (SELECT txt, label, year, unnest(string_split(txt, ' ')) AS term FROM s) WHERE length(term) >= 2 AND term NOT IN ({stop}) GROUP BY ALL),
idf AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM train) + 1) / (count(*) + 1.0)) AS idf FROM words WHERE year <= 2021 GROUP BY term HAVING count(*) >= 5 ORDER BY sum(tf) DESC, term LIMIT 20000),
sums AS (SELECT label, term, sum(tf * idf) AS s FROM words JOIN idf USING (term) WHERE year <= 2021 GROUP BY ALL), tot AS (SELECT label, sum(s) AS t FROM sums GROUP BY label),
cls AS MATERIALIZED (SELECT label, ln(count(*) + 1.0) - ln((SELECT count(*) FROM train) + (SELECT count(DISTINCT label) FROM train) * 1.0) AS share, ln(coalesce(any_value(t), 0) + (SELECT count(*) FROM idf)) AS den FROM train LEFT JOIN tot USING (label) GROUP BY label),
tw AS MATERIALIZED (SELECT txt, term, tf * idf AS w FROM words JOIN idf USING (term) WHERE year > 2021),
likelihood AS (SELECT t.txt, c.label AS y, c.share + coalesce(sum(tw.w * (ln(coalesce(s, 0) + 1) - c.den)), 0) AS score FROM test t CROSS JOIN cls c LEFT JOIN tw ON tw.txt = t.txt LEFT JOIN sums ON sums.label = c.label AND sums.term = tw.term GROUP BY t.txt, c.label, c.share),
predicted AS (SELECT txt, y AS prediction FROM likelihood QUALIFY row_number() OVER (PARTITION BY txt ORDER BY round(score, 9) DESC, y) = 1), p AS MATERIALIZED (SELECT t.label, t.n_repeats, prediction FROM test t JOIN predicted USING (txt))"""


def _metrics_sql(name, where="true"):
    return f"""{name}_c AS (SELECT label, prediction, count(*) AS n FROM p WHERE {where} GROUP BY 1, 2), {name}_k AS (SELECT label AS c FROM {name}_c UNION SELECT prediction FROM {name}_c),
{name}_m AS (SELECT k.c, coalesce(sum(n) FILTER (WHERE label = k.c AND prediction = k.c), 0) AS tp, coalesce(sum(n) FILTER (WHERE label <> k.c AND prediction = k.c), 0) AS fp, coalesce(sum(n) FILTER (WHERE label = k.c AND prediction <> k.c), 0) AS fn FROM {name}_k k, {name}_c GROUP BY k.c),
{name} AS (SELECT round(100.0 * sum(tp) / sum(tp + fn), 6) AS accuracy_pct, round(avg(coalesce(f, 0)), 6) AS macro_f1, round(sum(coalesce(f, 0) * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1, count(*) AS k, CAST(sum(tp + fn) AS BIGINT) AS n FROM (SELECT *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM {name}_m))"""


def _bayes(spark, sf_dir, digits):
    train, test = Y.split_by_year(settled(coded_texts(spark, sf_dir, digits)), "year", 2021, 0)
    return Y.naive_bayes(train, test, "txt", "label", M.words(F.col("txt"), M.STOP, 2)).where("prediction is not null")


@query(f"WITH {_coded_sql(2)}, {_metrics_sql('m')} SELECT * FROM m")
def classifier_naive_bayes(spark, sf_dir):
    """M6: Naive Bayes at two digits of the code, tested on later years."""
    return Y.metrics(Y.confusion(_bayes(spark, sf_dir, 2), "label", "prediction"), None)


@query(f"WITH {_coded_sql(4)}, {_metrics_sql('a')}, {_metrics_sql('b', 'n_repeats = 1')} SELECT a.macro_f1 AS macro_f1_all, a.n AS n_all, b.macro_f1 AS macro_f1_single, b.n AS n_single, abs(a.macro_f1 - b.macro_f1) <= 0.02 AS stable FROM a, b")
def classifier_contamination(spark, sf_dir):
    """M6, M8: Naive Bayes at four digits, and the same model on texts seen once."""
    return Y.contamination(settled(_bayes(spark, sf_dir, 4)), "n_repeats", "label", "prediction", empty=None)


@query()
def classifier_logistic(spark, sf_dir):
    """M6, M8: logistic regression on TF-IDF at two digits, and the same on texts seen once."""
    train, test = Y.split_by_year(settled(coded_texts(spark, sf_dir, 2)), "year", 2021, 0)
    if train.isEmpty():  # no model, no prediction
        found = test.limit(0).select("n_repeats", F.lit(0.0).alias("_label"), F.lit(0.0).alias("prediction"))
    else:
        found = settled(Y.text_pipeline("lr", "txt", "label", M.STOP).fit(train).transform(test).select("n_repeats", "_label", "prediction"))
    return Y.contamination(found, "n_repeats", "_label", "prediction", empty=None)


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    items = e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("id"), F.col("label").alias("family"), F.col("embedding").alias("vector"), (F.col("vec_id") % 9 + 1).alias("weight"))
    cat = e.where("vec_id % 4 = 0 AND label <> 3").select(F.col("label").alias("family"), F.col("embedding").alias("vector"), F.col("vec_id").alias("code"))
    return items, cat


_BEST = """i AS (SELECT vec_id AS id, label AS family, embedding AS v, vec_id % 9 + 1 AS weight FROM embeddings WHERE vec_id % 4 <> 0), c AS (SELECT label AS family, embedding AS v, vec_id AS code FROM embeddings WHERE vec_id % 4 = 0 AND label <> 3),
p AS (SELECT i.id, i.family, i.weight, c.code, list_cosine_similarity(CAST(i.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS sim FROM i LEFT JOIN c USING (family)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC NULLS LAST, code NULLS LAST) AS rk FROM p)"""


@query(f"WITH {_BEST} SELECT id, family, code AS best_code, round(sim, 6) AS best_sim, code IS NULL AS no_family FROM b WHERE rk = 1")
def best_sibling_cosine(spark, sf_dir):
    """The best sibling of each item by cosine; families without any stay."""
    items, cat = vectors(spark, sf_dir)
    return M.best_sibling(items, cat, "id", "family", "vector", "code").withColumn("best_sim", F.round("best_sim", 6))


@query(f"""WITH {_BEST}, d AS (SELECT b.*, CASE WHEN id % 3 = 0 THEN code ELSE id - id % 4 END AS declared FROM b WHERE rk = 1)
SELECT family, count(*) AS n, round(100.0 * count(*) FILTER (WHERE coalesce(code = declared AND sim > 0, false)) / count(*), 6) AS best_pct, round(100.0 * coalesce(sum(CASE WHEN code = declared AND sim > 0 THEN weight END), 0) / sum(weight), 6) AS best_weight_pct,
  round(100.0 * count(*) FILTER (WHERE coalesce(sim, 0) <= 0) / count(*), 6) AS abstained_pct FROM d GROUP BY family""")
def declared_is_best(spark, sf_dir):
    """How often the declared code is the best of its family, by items and weight."""
    items, cat = vectors(spark, sf_dir)
    best = M.best_sibling(items, cat, "id", "family", "vector", "code").join(items.select("id", "weight"), "id")
    best = best.withColumn("declared", F.when(F.col("id") % 3 == 0, F.col("best_code")).otherwise(F.col("id") - F.col("id") % 4))
    return M.declared_is_best(best, "declared", "weight", ["family"])


def parts(spark, sf_dir):
    """The catalogue: every different part name, with the code of its first part."""
    p = table(spark, sf_dir, "part")
    name = C.norm_text(F.concat_ws(" ", "p_name", F.when(F.col("p_type") == "LARGE", "para"), "p_type", "p_brand"))
    return p.select("p_partkey", name.alias("name")).groupBy("name").agg(code8(F.min("p_partkey")).alias("code"))


def part_texts(spark, sf_dir):
    """Free texts of the parts, without the type: two in three declare their own name's code,
    the others one of their own that the catalogue may lack."""
    p = table(spark, sf_dir, "part")
    name = C.norm_text(F.concat_ws(" ", "p_name", F.when(F.col("p_type") == "LARGE", "para"), "p_type", "p_brand"))
    text = C.norm_text(F.concat_ws(" ", "p_brand", F.lit("para"), "p_name", F.when(F.col("p_partkey") % 7 == 0, F.lit("usado")), "p_size"))
    rows = p.select(F.col("p_partkey").alias("id"), name.alias("name"), text.alias("txt"))
    return rows.join(parts(spark, sf_dir), "name").select("id", "txt", F.when(F.col("id") % 3 == 0, code8(F.col("id"))).otherwise(F.col("code")).alias("declared"))


# words without stop words as counts; character grams as smoothed logarithms
_KINDS = {"words": (lambda c: M.words(c, M.STOP, 2), False), "grams": (M.char_grams, True)}


def _ranked(spark, sf_dir, kind="words"):
    terms, logs = _KINDS[kind]
    fitted = M.fit_catalogue(parts(spark, sf_dir), "code", terms(F.col("name")), logs, logs)
    return M.rank_declared(part_texts(spark, sf_dir), fitted, "id", terms(F.col("txt")), "declared")


def _split_sql(frame, key, text):
    stop = ", ".join(f"'{w}'" for w in M.STOP)
    return f"SELECT {key}, term FROM (SELECT {key}, unnest(string_split({text}, ' ')) AS term FROM {frame}) WHERE length(term) >= 2 AND term NOT IN ({stop})"


def _grams_sql(frame, key, text):
    return f"""SELECT {key}, substr(w, CAST(k AS BIGINT), n) AS term FROM (SELECT {key}, ' ' || unnest(string_split({text}, ' ')) || ' ' AS w FROM {frame}), (VALUES (3), (4), (5)) g(n), range(1, 60) r(k)
  WHERE length(w) > 2 AND k <= length(w) - n + 1"""


def _rank_sql(split, tf="tf", smooth=0):
    """Every text against every code: all pairs that share a term, and ranks by comparison."""
    code = lambda x: f"lpad(CAST({x} * 48611 % 100000000 AS VARCHAR), 8, '0')"
    name = _norm_sql("p_name", "CASE WHEN p_type = 'LARGE' THEN 'para' END", "p_type", "p_brand")
    text = _norm_sql("p_brand", "'para'", "p_name", "CASE WHEN p_partkey % 7 = 0 THEN 'usado' END", "p_size")
    return f"""named AS (SELECT *, {name} AS name FROM part), cat AS MATERIALIZED (SELECT name, {code("min(p_partkey)")} AS code FROM named GROUP BY name),
docs AS MATERIALIZED (SELECT p_partkey AS id, {text} AS txt, CASE WHEN p_partkey % 3 = 0 THEN {code("p_partkey")} ELSE cat.code END AS declared FROM named JOIN cat USING (name)),
ct AS (SELECT code, term, count(*) AS tf FROM ({split("cat", "code", "name")}) GROUP BY 1, 2), idf AS (SELECT term, ln((SELECT count(DISTINCT code) FROM cat) + 1.0) - ln(count(*) + 1.0) + {smooth} AS idf FROM ct GROUP BY term),
cw AS (SELECT code, term, {tf} * idf AS w FROM ct JOIN idf USING (term) WHERE idf > 1e-12), cn AS MATERIALIZED (SELECT code, term, w / sqrt(sum(w * w) OVER (PARTITION BY code)) AS w FROM cw),
dt AS (SELECT id, term, count(*) AS tf FROM ({split("docs", "id", "txt")}) GROUP BY 1, 2), dw AS (SELECT id, term, {tf} * idf AS w FROM dt JOIN idf USING (term) WHERE idf > 1e-12), dn AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM dw),
s AS MATERIALIZED (SELECT id, code, round(sum(dn.w * cn.w), 9) AS sim FROM dn JOIN cn USING (term) GROUP BY 1, 2),
o AS (SELECT d.id, d.declared, CASE WHEN c.code IS NOT NULL THEN coalesce(s.sim, 0.0) END AS declared_sim FROM docs d LEFT JOIN cat c ON c.code = d.declared LEFT JOIN s ON s.id = d.id AND s.code = d.declared),
a AS (SELECT o.id, count(*) AS n FROM o JOIN s ON s.id = o.id AND s.sim > o.declared_sim GROUP BY 1),
t AS (SELECT id, arg_max(code, -rk) AS top_code, max(sim) AS top_sim, string_agg(code, ' ' ORDER BY rk) AS top FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, code) AS rk FROM s WHERE sim > 0) WHERE rk <= 3 GROUP BY id),
j AS (SELECT o.id, o.declared, t.top_code, coalesce(t.top_sim, 0.0) AS top_sim, o.declared_sim, CASE WHEN o.declared_sim IS NOT NULL THEN 1 + coalesce(a.n, 0) END AS declared_rank,
  CASE WHEN t.top_code IS NULL THEN NULL WHEN t.top_code = declared THEN 8 WHEN substr(t.top_code, 1, 6) = substr(declared, 1, 6) THEN 6 WHEN substr(t.top_code, 1, 4) = substr(declared, 1, 4) THEN 4 WHEN substr(t.top_code, 1, 2) = substr(declared, 1, 2) THEN 2 ELSE 0 END AS level,
  coalesce(t.top, '') AS top FROM o LEFT JOIN a USING (id) LEFT JOIN t USING (id))"""


_WORD_RANK = _rank_sql(_split_sql)
_GRAM_RANK = _rank_sql(_grams_sql, "(1 + ln(tf))", 1)
_RANKS = "SELECT id, declared, top_code, round(top_sim, 6) AS top_sim, round(declared_sim, 6) AS declared_sim, declared_rank, level, top FROM j"


def _rounded(r):
    return r.withColumn("top_sim", F.round("top_sim", 6)).withColumn("declared_sim", F.round("declared_sim", 6))


@query(f"WITH {_WORD_RANK} {_RANKS}")
def tfidf_word_rank(spark, sf_dir):
    """Similarity and rank of the declared code among all, by word TF-IDF."""
    return _rounded(_ranked(spark, sf_dir))


_SUMMARY = ", ".join(f"round(100.0 * avg(CASE WHEN declared_rank <= {t} THEN 1 ELSE 0 END), 6) AS within_{t}" for t in (1, 3, 10, 100)) + ", round(100.0 * avg(CASE WHEN top_sim = 0 THEN 1 ELSE 0 END), 6) AS abstained_pct, " + ", ".join(f"round(100.0 * avg(CASE WHEN coalesce(level >= {d}, false) THEN 1 ELSE 0 END), 6) AS level_{d}" for d in (8, 6, 4, 2))


@query(f"WITH {_WORD_RANK} SELECT count(*) AS n, {_SUMMARY}, quantile_cont(declared_rank, 0.5) AS median_rank FROM j")
def match_quality(spark, sf_dir):
    """The distribution of ranks and agreement levels."""
    return M.match_summary(_ranked(spark, sf_dir))


@query(f"WITH {_GRAM_RANK} {_RANKS}")
def tfidf_char_rank(spark, sf_dir):
    """M4: similarity and rank of the declared code among all, by character 3-5-grams."""
    return _rounded(_ranked(spark, sf_dir, "grams"))


_WITHIN = "(SELECT round(100.0 * avg(CASE WHEN declared_rank <= 10 THEN 1 ELSE 0 END), 6) FROM j)"


@query(f"SELECT a AS first_rate, b AS second_rate, abs(a - b) <= 10 AS consistent FROM (WITH {_WORD_RANK} SELECT {_WITHIN} AS a), (WITH {_GRAM_RANK} SELECT {_WITHIN} AS b)")
def ranker_consistency(spark, sf_dir):
    """M9: whether ranks by words and by characters tell the same."""
    one = M.match_summary(_ranked(spark, sf_dir))
    return M.method_consistency(one, M.match_summary(_ranked(spark, sf_dir, "grams")), "within_10")


@query()
def lsa_rank(spark, sf_dir):
    """M5: similarity and rank of the declared code among all, in the latent space of 150
    components of the catalogue's character grams."""
    cat, grams = parts(spark, sf_dir), M.char_grams
    fitted = M.fit_catalogue(cat, "code", grams(F.col("name")), True, True)
    weights = settled(M.tfidf(cat, "code", grams(F.col("name")), sublinear=True, smooth=True)[0])
    space = A.fit(weights, "code", 150)
    return _rounded(A.rank_all(part_texts(spark, sf_dir), fitted, space, A.vectors(weights, space, "code"), "id", grams(F.col("txt")), "declared", "code"))


_FAMILY = f"""{_WORD_RANK.split("s AS MATERIALIZED (SELECT id, code, round")[0]}i AS (SELECT id, declared, substr(declared, 1, 2) AS family, id % 9 + 1 AS weight FROM docs), c AS (SELECT code, substr(code, 1, 2) AS family FROM cat WHERE substr(code, 1, 1) <> '7'),
ps AS (SELECT i.id, c.code, round(sum(dn.w * cn.w), 9) AS sim FROM i JOIN c USING (family) JOIN dn ON dn.id = i.id JOIN cn ON cn.code = c.code AND cn.term = dn.term GROUP BY 1, 2),
b AS (SELECT i.*, c.code, CASE WHEN c.code IS NOT NULL THEN coalesce(ps.sim, 0) END AS sim, row_number() OVER (PARTITION BY i.id ORDER BY coalesce(ps.sim, 0) DESC, c.code) AS rk FROM i LEFT JOIN c USING (family) LEFT JOIN ps ON ps.id = i.id AND ps.code = c.code)"""


def _siblings(spark, sf_dir):
    cat, docs = settled(parts(spark, sf_dir)), settled(part_texts(spark, sf_dir))
    cw, idf = M.tfidf(cat, "code", M.words(F.col("name"), M.STOP, 2))
    dw, _ = M.tfidf(docs, "id", M.words(F.col("txt"), M.STOP, 2), idf)
    items = docs.select("id", "declared", F.substring("declared", 1, 2).alias("family"), (F.col("id") % 9 + 1).alias("weight"))
    siblings = cat.where(F.substring("code", 1, 1) != "7").select("code", F.substring("code", 1, 2).alias("family"))
    return items, M.best_sibling_terms(items, dw, siblings, cw, "id", "family", "code")


@query(f"WITH {_FAMILY} SELECT id, family, code AS best_code, round(sim, 6) AS best_sim, code IS NULL AS no_family FROM b WHERE rk = 1")
def best_sibling_tfidf(spark, sf_dir):
    """The best sibling of each text in its code's family, by word TF-IDF."""
    return _siblings(spark, sf_dir)[1].withColumn("best_sim", F.round("best_sim", 6))


@query(f"""WITH {_FAMILY} SELECT family, count(*) AS n, round(100.0 * count(*) FILTER (WHERE coalesce(code = declared AND sim > 0, false)) / count(*), 6) AS best_pct, round(100.0 * coalesce(sum(CASE WHEN code = declared AND sim > 0 THEN weight END), 0) / sum(weight), 6) AS best_weight_pct,
  round(100.0 * count(*) FILTER (WHERE coalesce(sim, 0) <= 0) / count(*), 6) AS abstained_pct FROM b WHERE rk = 1 GROUP BY family""")
def declared_is_best_tfidf(spark, sf_dir):
    """How often the declared code is the best of its family, by texts and weight."""
    items, best = _siblings(spark, sf_dir)
    return M.declared_is_best(best.join(items.select("id", "declared", "weight"), "id"), "declared", "weight", ["family"])


@query()
def word2vec_sibling(spark, sf_dir):
    """The best sibling by Word2Vec over the joint corpus."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("family"), M.words(C.norm_text(F.concat_ws(" ", "p_type", "p_brand"))).alias("terms"))
    cat = p.where("id % 5 = 0")
    model = M.word_vectors(p.select("terms").unionByName(cat.select("terms")), "terms", size=100)
    # equal texts of a family have one vector and one sibling
    items = p.where("id % 5 <> 0")
    distinct = settled(items.groupBy("family", "terms").agg(F.min("id").alias("one")))
    codes = cat.groupBy("family", "terms").agg(F.min("id").alias("code"))
    best = M.best_sibling(M.embed(model, distinct), M.embed(model, codes), "one", "family", "vector", "code").drop("family")
    best = distinct.join(best, "one").withColumnRenamed("family", "_f").withColumnRenamed("terms", "_terms")
    out = items.join(best, F.col("family").eqNullSafe(F.col("_f")) & F.col("terms").eqNullSafe(F.col("_terms")))
    return out.select("id", "family", "best_code", "best_sim", "no_family")


@query(f"""WITH {_LINES}, p AS (SELECT txt, code, count(*) AS n FROM f WHERE txt IS NOT NULL GROUP BY 1, 2), u AS (SELECT * FROM p ORDER BY n DESC, txt, code LIMIT 100)
SELECT (SELECT count(*) FROM p) AS n_pairs, (SELECT CAST(sum(n) AS BIGINT) FROM p) AS n_rows, count(*) AS used_pairs, CAST(sum(n) AS BIGINT) AS used_rows, (SELECT count(*) FROM p) - count(*) AS omitted_pairs, round(100.0 * sum(n) / (SELECT sum(n) FROM p), 6) AS covered_pct FROM u""")
def frequency_capped_pairs(spark, sf_dir):
    """What the hundred most frequent pairs cover, and what they leave out."""
    # what the pairs cover does not depend on the order of equal counts, so digests stand for texts
    pairs = lines(spark, sf_dir).where("txt is not null").groupBy(F.sha2("txt", 256).alias("digest"), "code").agg(F.count("*").alias("n"))
    return M.frequency_cut(settled(pairs), "n", 100, ["digest", "code"])[1]


@query(f"WITH {_WORD_RANK} SELECT id, declared, top_code, declared_rank FROM j WHERE top_sim > 0.3 AND level < 8 ORDER BY declared_rank DESC NULLS LAST, id LIMIT 25")
def heaviest_disagreements(spark, sf_dir):
    """T4, T5: the worst ranks among texts that match something well."""
    r = _ranked(spark, sf_dir).where("top_sim > 0.3 AND level < 8").select("id", "declared", "top_code", "declared_rank")
    return r.orderBy(F.desc_nulls_last("declared_rank"), "id").limit(25)
