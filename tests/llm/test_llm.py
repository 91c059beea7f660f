"""The training-data operators against brute force, round trips and awkward tables."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat, common, components, fertility, hamming, htmltext, jaccard, langid, mixing, sharding, simhash, toxicity
from ledgerlens.llm.common import crc_mod

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "Hello there, general public.", "en", "a", 28), (4, "Hello there, general public.", "en", "a", 28),
    (None, "a row without an id", "en", None, 3), (5, LONG, "fr", "b", len(LONG)), (6, "### $$$ 123", "de", "b", 11), (7, "naïve ça été où", "fr", "a", 15), (8, "Hello there, general public.", None, "a", 28),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls everywhere, blank and very long texts, repeated rows, a clashing column."""
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    sounds = {"aa": "ka mo ti ru sel van por ist".split(), "bb": "zhe kry olo wim dax fen gul yor".split()}
    rows = []
    for k in range(n):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((k, " ".join(words), lang, f"src{rng.randint(0, 3)}", 0))
    return rows


# --- 1: toxicity


def toxic_corpus(n=600):
    rng, rows, labels = random.Random(5), [], []
    for k, text, lang, source, _ in corpus(n):
        words = text.split()
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["wretch", "vermin", "dolt", "maggot"]))
        rows.append((k, " ".join(words), lang, source, 0))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_from_its_folds_only(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    # labels of the held-out fold are turned round: a model that saw them would suffer
    wrong = lab.withColumn("toxic", F.when(crc_mod("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.train(docs, wrong, rounds=8)
    assert "=vermin" in model.lexicon
    got = toxicity.classify(docs, model).join(lab, "doc_id").where(crc_mod("doc_id", 5) == 0)
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.acc > 0.95 and 0 <= r.lo and r.hi <= 1
    clean = toxicity.keep_clean(docs.withColumn("score", F.lit(0)), model)
    assert clean.columns == [*docs.columns, "score"] and 0.6 < clean.count() / docs.count() < 0.9


def test_lexicon_equals_brute_force(spark):
    from collections import Counter

    rows, labels = toxic_corpus()
    df = spark.createDataFrame([(t + " \n", float(y[2])) for (_, t, *_), y in zip(rows, labels, strict=True)] + [(None, 0.0), ("", 1.0)], "text string, label double")
    seen = (Counter(), Counter())
    for (_, t, *_), (_, _, y) in zip(rows, labels, strict=True):
        seen[y].update({k for w in set(t.lower().split()) for k in ["=" + w, *(w[:n] for n in (4, 5, 6, 7) if n < len(w))]})
    a, b = (sum(n for k, n in seen[y].items() if k.startswith("=")) for y in (1, 0))
    want = {}
    for k in seen[0] | seen[1]:
        x, y = seen[1][k], seen[0][k]
        g2 = 2 * sum(o * math.log(o / ((x + y) * s)) for o, s in ((x, a / (a + b)), (y, b / (a + b))) if o)
        weight = math.log((x + 0.5) / a) - math.log((y + 0.5) / b)
        if x >= 4 and g2 >= 25 and weight >= math.log(4):
            want[k] = weight
    for parts in (1, 7):
        assert toxicity.learn_lexicon(df.repartition(parts)) == pytest.approx(want)
    assert {"=wretch", "=vermin", "=dolt", "=maggot"} <= set(want)


def plain_features(text, lexicon):
    """The features by their definition, token for token."""
    words = text.split()
    flags = []
    for w in words:
        low = w.lower().strip(".,!?")
        own, stem = lexicon.get("=" + low), max((lexicon.get(low[:k], 0) for k in (4, 5, 6, 7) if k < len(low)), default=0)
        flags.append((own is not None, own is None and stem > 0, max(own or 0, stem), low in toxicity.SECOND_PERSON, sum(c.isalpha() for c in w), sum(c.isupper() for c in w)))
    n, hit = len(words), [f[0] or f[1] for f in flags]
    near = sum(any(flags[j][3] for j in range(max(0, i - 3), min(n, i + 4))) for i in range(n) if hit[i])
    letters, punct = sum(f[4] for f in flags), sum(not c.isalnum() for c in text if not c.isspace())
    shouted = sum(f[4] > 1 and f[4] == f[5] for f in flags)
    return [
        math.log1p(n), sum(f[0] for f in flags), 100 * sum(f[0] for f in flags) / n, sum(f[1] for f in flags), 100 * sum(f[1] for f in flags) / n, sum(f[2] for f in flags) / n, max(f[2] for f in flags),
        max(sum(hit[i : i + 20]) for i in range(n)), 100 * sum(f[3] for f in flags) / n, near / max(1, sum(hit)), sum(f[5] for f in flags) / max(1, letters), shouted / n, text.count("!") / n, text.count("?") / n,
        punct / max(1, letters + punct), 0.0, 0.0,
    ]


def test_features_equal_their_definition():
    rng, lexicon = random.Random(4), {"=dolt": 2.0, "verm": 1.5, "=vermin": 2.5}
    pool = "dolt vermin vermins you your kamot RIST Sel dolt! vermins, you? tiru. DOLT! a".split()
    tokens = toxicity._Tokens(lexicon)
    for _ in range(200):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))
        assert toxicity.text_features(text, tokens) == pytest.approx(plain_features(text, lexicon), rel=1e-6), text


def test_a_trained_model_meets_awkward_rows(spark, awkward, empty):
    rows, labels = toxic_corpus(300)
    # equal texts under several ids and labels: the least id, toxic if one is
    rows += [(5000 + k, rows[k][1], "aa", "s", 0) for k in range(40)]
    labels += [(5000 + k, None, 1 - labels[k][2]) for k in range(40)] + [(None, 0, 1), (1, 0, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = (toxicity.train(docs.repartition(n), lab, rounds=3) for n in (1, 5))
    assert one.lexicon == two.lexicon and one.trees is not None
    odd = awkward.withColumns({c: F.lit("x") for c in ("text_", "vec", "prob", "log_words")})
    got = toxicity.classify(odd, one).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    assert toxicity.classify(empty, one).count() == 0 and toxicity.keep_clean(empty, one).count() == 0
    assert toxicity.keep_clean(odd, one).columns == odd.columns


def test_toxicity_of_awkward_tables(spark, awkward, empty):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = toxicity.train(awkward, lab)
    assert [r.predicted for r in toxicity.classify(awkward, none).collect()] == [0] * len(AWKWARD)
    assert toxicity.classify(empty, none).count() == 0
    tokens = toxicity._Tokens({"=dolt": 2.0})
    assert toxicity.text_features(None, tokens) == toxicity.text_features(" ", tokens) == [0.0] * len(toxicity.FEATURES)
    f = dict(zip(toxicity.FEATURES, toxicity.text_features("you DOLT! d0lt, dolt", tokens), strict=True))
    assert f["word_hits"] == 2 and f["masked_hits"] == 1 and f["near_second_person"] == 1 and f["densest"] == 3


# --- 2: language


def ppm_bits(text, counts):
    """Code length of a text by plain PPM (method C, no exclusion) over dictionaries."""
    data, bits = b"\0\0\0" + text, 0.0
    for i in range(3, len(data)):
        for depth in (3, 2, 1, 0, -1):
            if depth < 0:
                bits += 8
                break
            seen = counts[depth].get(data[i - depth : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(whole / seen[data[i]])
                break
            bits += math.log2(whole / len(seen))
    return bits


def test_code_lengths_are_those_of_plain_ppm(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    trees = langid.train(docs)
    texts = [t.encode() for _, t, *_ in corpus(20, seed=9)] + [b"", "ünseen 一 bytes".encode()]
    got = trees.code_lengths(texts, step=97)
    for k, lang in enumerate(trees.langs):
        counts = [{} for _ in range(4)]
        for _, t, own, *_ in rows:
            if own == lang:
                data = b"\0\0\0" + t.encode()
                for i in range(3, len(data)):
                    for d in range(4):
                        c = counts[d].setdefault(data[i - d : i], {})
                        c[data[i]] = c.get(data[i], 0) + 1
        assert got[:, k] == pytest.approx([ppm_bits(t, counts) for t in texts], rel=1e-4)


def test_languages_are_told_apart_held_out(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    held_out = crc_mod("doc_id", 3) == 1
    trees = langid.train(docs, where=~held_out)
    got = langid.identify(docs, trees).where(held_out).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_languages_of_awkward_tables(spark, awkward, empty):
    trees = langid.train(awkward)
    got = langid.identify(awkward, trees).collect()
    by = {(r.doc_id, k): r for k, r in enumerate(got)}
    assert len(got) == len(AWKWARD) and all(r.lang_pred == "und" and r.score == 0 for (i, _), r in by.items() if i in (1, 2, 3, 6))
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(awkward, trees)
    assert kept.columns == awkward.columns and kept.count() == 6
    assert langid.train(awkward.withColumn("doc_id", F.lit(None).cast("long"))) is None
    with pytest.raises(ValueError):
        langid.shared_trees(spark, trees, most=1000)
    assert langid.train(empty) is None and langid.keep_identified(awkward, None).count() == 0
    assert langid.identify(empty, trees).count() == 0 and langid.identify(awkward, None).count() == len(AWKWARD)


def test_pipeline_rejects_texts_of_no_learned_language(spark):
    import base64

    import corpus_pipeline

    rng = random.Random(12)
    good = corpus(400) + [(500, "ka mo ti", "aa", "s", 0), (501, "zhe", "bb", "s", 0)]
    noise = [base64.b64encode(rng.randbytes(300)).decode(), rng.randbytes(200).hex(), "".join(rng.choices("asdfghjklqwertyuiop ", k=400)), " ".join("".join(rng.choices(["quo", "bae", "cyf", "njo", "hu"], k=3)) for _ in range(60)), "Ж" * 200]
    rows = good + [(600 + k, t, "aa", "s", 0) for k, t in enumerate(noise)] + [(700, "123", "aa", "s", 0), (701, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.language_id(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in good)


# --- 3: top-k


def test_top_k_equals_brute_force(spark):
    rng = random.Random(2)
    codes = [(k, rng.getrandbits(64) - (1 << 63)) for k in range(600)] + [(1000 + k, 5) for k in range(40)] + [(2000, None), (None, 7)]
    df = spark.createDataFrame(codes, "id long, code long")
    asked = [c for c in codes if c[0] is not None and c[0] % 100 == 0 and c[1] is not None]
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in hamming.top_k(df, df.where("id % 100 = 0"), k=12).collect()}
    for q, code in asked:
        near = sorted((((code ^ c) & (2**64 - 1)).bit_count(), i) for i, c in codes if i is not None and c is not None)[:12]
        assert [got[q, n + 1] for n in range(12)] == [(i, d) for d, i in near]
    assert len(got) == 12 * len(asked)


def test_top_k_of_few_rows_and_repeats(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (3, 2)], "id long, code long")
    got = sorted((r["rank"], r.id, r.distance) for r in hamming.top_k(df, df.limit(1), k=10).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (3, 3, 2)]
    assert hamming.top_k(df.limit(0), df, k=3).count() == 0 and hamming.top_k(df, df.limit(0), k=3).count() == 0
    v = spark.createDataFrame([([1.0, -1.0, None, 0.5],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in v.select(hamming.sign_code(F.col("v"))).collect()] == [9, None, 0]
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming.sign_code(F.col("v"))).collect()


def test_top_k_grows_radii_only_while_needed(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(20)]
    codes = [(100 * k, b) for k, b in enumerate(base)] + [(1001 + 10 * k + j, b ^ (1 << (5 * j))) for k, b in enumerate(base) for j in range(10)]
    df = spark.createDataFrame(codes, "id long, code long").withColumns({"q": F.lit(1), "distance": F.lit("x")})
    for segments, want in ((8, 1), (4, 1), (2, 1)):  # ten codes at distance 1: known after radius 0, as 1 < segments
        steps = []
        got = hamming.top_k(df, df.where("id % 100 = 0 and id < 1000"), k=5, segments=segments, steps=steps).collect()
        assert len(steps) == want and len(got) == 50 and {r.distance for r in got} == {0, 1}
    steps = []
    hamming.top_k(df, df.where("id = 0"), k=60, steps=steps).count()
    assert [r for r, _ in steps] == list(range(len(steps))) and 1 < len(steps) < 9


def test_outlying_queries_read_the_values_there_are(spark):
    """Codes near zero and a query far off: with two segments of 32 bits the radius 15 alone
    has 565,722,720 values, while the index has 300."""
    rng = random.Random(11)
    codes = [(100 * k + 1, sum(1 << b for b in rng.sample(range(63), 3))) for k in range(300)] + [(0, 0x0007FFFF0000FFF0), (100, 7)]
    df = spark.createDataFrame(codes, "id long, code long")
    for segments in (2, 8):
        steps = []
        got = hamming.top_k(df, df.where("id % 100 = 0"), k=5, segments=segments, steps=steps, per_block=64).collect()
        for q in (0, 100):
            own = dict(codes)[q]
            near = sorted((((own ^ c) & (2**64 - 1)).bit_count(), i) for i, c in codes)[:5]
            assert [(r.distance, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == near
        assert steps[-1][0] * segments > 20 and steps[-1][1] == 1


def test_values_at_a_radius_are_all_of_them(spark):
    todo = spark.createDataFrame([(5, 9)], "q long, kth int")
    for width, radius in ((8, 0), (8, 3), (8, 8), (16, 5), (32, 2)):
        got = [(r.seg, r.val) for r in hamming._named(todo, 64 // width, width, radius).collect()]
        want = {(j, (5 if j == 0 else 0) ^ sum(1 << b for b in bits)) for j in range(64 // width) for bits in itertools.combinations(range(width), radius)}
        assert len(got) == len(want) and set(got) == want


# --- 4: BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    lib, own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.ByteBPE(vocabulary)
    rng = random.Random(4)
    texts = ["", "   ", "a\n\n  b", "<|endoftext|>x<|endoftext|><|endoftext|>", " " * 5000, "a" * 20000, "é" * 3000, "it's we'LL 'S", "\x1c\x1d a\x85b　 c", "ab" * 9000]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x370, 0x3000), rng.randint(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_ids_with_a_small_cache(vocabulary):
    own, rng = bpe.ByteBPE(vocabulary, known_ids=20), random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(9000)) + "<|endoftext|>", "", "é 一 😀\n\n  x"]
    for t in texts:
        assert own.packed(t) == b"".join(int(x).to_bytes(4, "little") for x in own.round_trip(t)[1].split(",") if x)
    assert len(own.ids_cache) <= 4200  # and not a generation for each text


def test_bpe_of_tables(spark, awkward, empty, vocabulary):
    out = bpe.encode(awkward.withColumn("n_tokens", F.lit(0)), vocabulary)
    assert out.columns[-2:] == ["_n_tokens", "token_ids"]
    back = bpe.decode(out.drop("text"), vocabulary).select("doc_id", "text").collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in AWKWARD)
    r = {x.doc_id: x for x in bpe.round_trip_digests(awkward, vocabulary).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (r[1].n_tokens, r[1].ids_sha256, r[1].decoded_sha256) == (0, nothing, nothing)
    assert r[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.encode(empty, vocabulary).count() == 0


# --- 5: HTML


@pytest.fixture(scope="module")
def crf():
    return htmltext.train(htmltext.labelled_pages(250), rounds=100)


def test_crf_on_pages_it_has_not_seen(crf):
    wrong = total = 0
    for page in htmltext.labelled_pages(120, seed=77):
        found = htmltext.blocks(page)
        gold = [int(b.text.startswith(htmltext.MARK)) for b in found]
        for b in found:
            b.text = b.text.replace(htmltext.MARK, "") or "."
        wrong += sum(a != b for a, b in zip(gold, crf.decode(htmltext.features(found)), strict=True))
        total += len(gold)
    assert wrong / total < 0.02


def test_viterbi_is_the_best_of_all_labellings(crf):
    for page in htmltext.labelled_pages(10, seed=5):
        rows = htmltext.features(htmltext.blocks(page.replace(htmltext.MARK, "")))[:9]
        s = crf.scores(rows)
        score = lambda y: crf.first[y[0]] + sum(s[t, y[t]] for t in range(len(y))) + sum(crf.pair[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert score(best) == pytest.approx(score(crf.decode(rows)))


def test_main_text_of_pages(spark, crf):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-banner">We use cookies to serve you better.</div><article><h1>Big &amp; small</h1><p><b>One two &lt;three&gt;<br>four&nbsp; five.<p>Six <i>se</i>ven.</p><div class="ad">Buy now</div></article>
    <section class="comments"><p>I disagree with all of this.</p></section><footer>&copy; 2020 somebody</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<nav>only a menu</nav>"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract(rows, crf).collect()]
    text = "Big & small One two <three> four five. Six seven."
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (None, "", 0), (4, "", 0), (1, text, len(text))]
    assert htmltext.extract(rows.limit(0), crf).count() == 0


def test_blocks_survive_broken_markup():
    for page in ("<", "<p", "<!--", "<a href='x", "</b></p>x", "<script>", "<p><table><tr><td>a<td>b</table>", "&#x;&amp &bogus;", "<![CDATA[x<y]]>", "<" * 3000, "<div>" * 3000 + "x"):
        htmltext.blocks(page)
    assert [b.text for b in htmltext.blocks("<p>a<p>b<li>c<li>d")] == ["a", "b", "c", "d"]


def test_deep_pages_take_time_in_proportion(crf):
    deep = {
        "nested": lambda n: "<div><p>x</p>" * n, "open inline": lambda n: "<b>" * n + "<p>x</p>" * n, "blanks": lambda n: "<i> " * n + "x<i>" * n,
        "cells": lambda n: "<table><tr><td>" + "<b>" * n + "<p>x</p><td>y" * n, "classes": lambda n: '<div class="a b"><span>x' * n, "ends": lambda n: "<div>" * n + "</b>x" * n + "</div>" * n,
    }
    for page in deep.values():
        took = []
        for n in (2_000, 16_000):
            began = time.monotonic()
            htmltext.main_text(page(n), crf)
            took.append(time.monotonic() - began)
        assert took[1] < 6 and took[1] < 30 * max(took[0], 0.05)


# pages written by hand, in manners of their own, and the text that a reader would call theirs
BY_HAND = [
    ("""<html><head><title>Harbour news</title></head><body><div id="top-bar"><a href="/">Harbour Gazette</a> <a href="/login">Sign in</a></div>
    <nav><a href="/a">World</a><a href="/b">Sport</a><a href="/c">Weather</a></nav>
    <main><article><h1>Ferry returns after long repair</h1><p class="lead">The old ferry crossed the bay again on Monday, nine months after a fire in its engine room.</p>
    <p>Hundreds came to watch. &ldquo;I took it to school every day,&rdquo; said one of them.</p><aside class="related"><h3>More on this</h3><ul><li><a href="/x">Fire on the ferry</a></li><li><a href="/y">Bay bridge plans</a></li></ul></aside>
    <p>Tickets cost the same as before the fire.</p></article></main>
    <section id="comments"><h2>Comments (2)</h2><div class="comment"><p>Good to see her back on the water.</p></div></section><footer><p>Copyright Harbour Gazette. All rights reserved.</p></footer></body></html>""",
     "Ferry returns after long repair The old ferry crossed the bay again on Monday, nine months after a fire in its engine room. Hundreds came to watch. “I took it to school every day,” said one of them. Tickets cost the same as before the fire."),
    ("""<body><div class="cookie-banner"><p>This site uses cookies. By going on you accept them.</p><button>Accept</button></div><div class="header"><ul class="menu"><li><a href=1>Home</a><li><a href=2>Recipes</a><li><a href=3>About</a></ul></div>
    <div class="post-content"><h2>Lentil soup</h2><p>Wash the lentils and let them stand for an hour in cold water before you begin.<p>You need:<ul><li>two cups of lentils<li>one onion<li>a spoon of cumin</ul><p>Boil all of it gently until the lentils are soft, then add salt.</div>
    <div class="sidebar"><h4>Popular</h4><a href=4>Bean stew</a> <a href=5>Flat bread</a></div><div class="ads"><p>Buy the best pots in town, now cheaper than ever!</p></div><div id="footer">&copy; Kitchen notes 2021</div></body>""",
     "Lentil soup Wash the lentils and let them stand for an hour in cold water before you begin. You need: two cups of lentils one onion a spoon of cumin Boil all of it gently until the lentils are soft, then add salt."),
    ("""<!doctype html><header><h1><a href="/">The slow blog</a></h1><p>Notes on walking</p></header><article><header><h2>Over the pass</h2></header><p>We left the hut before sunrise and met nobody until noon.</p><blockquote>Whoever hurries arrives twice.</blockquote><p>At the top the wind was so strong that we could hardly stand.</p>
    <div class="share-buttons"><a href="#">Share</a><a href="#">Print</a></div></article><form class="newsletter"><label>Get these notes by mail</label><input><button>Subscribe</button></form><footer><nav><a href="/imprint">Imprint</a></nav></footer>""",
     "Over the pass We left the hut before sunrise and met nobody until noon. Whoever hurries arrives twice. At the top the wind was so strong that we could hardly stand."),
    ("""<html><body><table width=100%><tr><td class=nav><ul><li><a href=a.htm>Index</a><li><a href=b.htm>Links</a></ul></td><td><p>The lighthouse was built of grey stone in the year of the great storm.</p><p>Its keeper lived there with a family of seven, and kept a diary that still exists.</p></td></tr></table></body></html>""",
     "The lighthouse was built of grey stone in the year of the great storm. Its keeper lived there with a family of seven, and kept a diary that still exists."),
]


@pytest.fixture(scope="module")
def production_crf():
    return htmltext.train(htmltext.labelled_pages(900))


SHELLS = [
    "<article>%s</article>", '<div class="content">%s</div>', "<div>%s</div>", "<section>%s</section>", '<div class="c1">%s</div>', '<div class="css-1x2y">%s</div>',
    '<div id="wrapper">%s</div>', '<div class="row"><div class="col">%s</div></div>', '<div class="Kq8_f"><section class="zz"><div>%s</div></section></div>',
]
PLAIN = """<h1>Ferry returns after long repair</h1><p>The old ferry crossed the bay again on Monday, nine months after a fire in its engine room.</p>
<p>Hundreds came to watch the boat. "I took it to school every day," said one of them.</p><p>Tickets cost the same as before the fire.</p>"""
AROUND = [
    '<header><h1><a href="/">Site</a></h1></header><nav><ul><li><a href=1>Home</a></li><li><a href=2>World</a></li></ul></nav>%s<footer><p>Copyright 2020 Site. All rights reserved.</p></footer>',
    '<div class="header"><a href="/">Site</a></div><ul class="menu"><li><a href=1>Home</a></li><li><a href=2>World</a></li></ul>%s<div id="footer">&copy; 2020 Site</div>',
    '<div id="page"><nav><a href=1>Home</a> <a href=2>World</a></nav>%s<aside class="sidebar"><h3>More</h3><ul><li><a href=3>Bay</a></li></ul></aside><footer>&copy; 2020 Site</footer></div>',
]


@pytest.mark.parametrize("shell", SHELLS)
def test_an_article_is_kept_in_any_shell(production_crf, shell):
    want = " ".join(b.text for b in htmltext.blocks(PLAIN))
    for page in AROUND:
        got = htmltext.main_text(f"<html><body>{page % (shell % PLAIN)}</body></html>", production_crf)
        kept = sum(w in got.split() for w in want.split()) / len(want.split())
        assert kept >= 0.95 and "Home" not in got and "2020" not in got, (kept, got)


def test_a_page_of_many_names_takes_little_memory(production_crf):
    import tracemalloc

    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k % 26] + letters[k // 26 % 26] + letters[k // 676]
    page = "".join(f'<div class="n{name(k)}"><x-{name(k)}>t' for k in range(16_000))
    tracemalloc.start()
    began = time.monotonic()
    htmltext.main_text(page, production_crf)
    took, most = time.monotonic() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 12 and most < 200e6  # traced: some three times as long as else


def test_crf_on_pages_of_another_hand(production_crf):
    from collections import Counter

    model = production_crf
    for page, want in BY_HAND:
        got = Counter(htmltext.main_text(page, model).split())
        gold = Counter(want.split())
        both = sum((got & gold).values())
        f1 = 2 * both / (sum(got.values()) + sum(gold.values()))
        assert f1 > 0.9, (f1, htmltext.main_text(page, model))


# --- 6: near-duplicates


def brute_components(rows):
    import xxhash

    def fingerprint(t):
        words = (t or "").encode().lower().split()
        got = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in got]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [(d, fingerprint(t)) for d, t in rows]
    group = {f: {f} for _, f in fp}
    for a, b in itertools.combinations(list(group), 2):
        if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
            both = group[a] | group[b]
            for f in both:
                group[f] = both
    least = {f: min((d for d, g in fp if g in group[f] and d is not None), default=None) for _, f in fp}
    return sorted(((d, f"{f:016x}", least[f]) for d, f in fp), key=str)


def test_simhash_equals_brute_force(spark, awkward, empty):
    rng = random.Random(8)
    rows = [(d, t) for d, t, *_ in AWKWARD]
    for k, text, *_ in corpus(120):
        rows.append((100 + k, text))
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((400 + k, " ".join(words)))
        rows.append((700 + k, text.upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    for size in (2048, 3):  # the second deals every shard into chunks
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, shard_rows=size).collect()), key=str)
        assert got == brute_components(rows)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 6, 7, None]


def test_simhash_keeps_rows_and_not_ids(spark):
    a, b = "one two three four five six", "entirely other words stand in this text"
    rows = [(1, a, "x"), (7, b, "y"), (7, a, "z"), (7, b, "y"), (9, b, None), (None, a, "n"), (3, None, "e"), (2, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (7, b), (None, a), (2, "")], key=str)


def test_simhash_of_one_ball(spark):
    """16,000 fingerprints that differ in 14 bits: large shards are cut again."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    ball = [base ^ x for x in rng.sample(range(1 << 14), 16_000)]
    far = [base ^ (0b1111111 << 14) ^ (x << 40) for x in range(0, 1 << 14, 127)]  # apart from the ball
    rows = [(c - (1 << 64) if c >> 63 else c,) for c in {*ball, *far}]
    df = spark.createDataFrame(rows, "fp long").select("fp", F.col("fp").alias("rep"))
    began = time.monotonic()
    got = {r.node: r.component for r in components.components(simhash.fingerprint_links(df)).collect()}
    assert time.monotonic() - began < 60
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    assert len({got[signed(c)] for c in ball}) == 1
    group = {c: {c} for c in far}
    for x, y in itertools.combinations(far, 2):
        if (x ^ y).bit_count() <= 3 and group[x] is not group[y]:
            both = group[x] | group[y]
            for c in both:
                group[c] = both
    for c in far:
        assert {signed(x) for x in group[c]} == {x for x in map(signed, far) if got.get(x, x) == got.get(signed(c), signed(c))}


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    codes = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(10)]
    tree = simhash.BKTree()
    for k, c in enumerate(codes):
        tree.add(c, k)
    for c in codes:
        assert sorted(tree.within(c, 3)) == [k for k, x in enumerate(codes) if (x ^ c).bit_count() <= 3]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(80)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_drops_all_copies_of_similarity_08(spark, monkeypatch):
    import corpus_pipeline

    rng, rows = random.Random(4), []
    for k, text, *_ in corpus(60):
        words = (text + " " + text[::-1]).split() * 2
        words = [f"{w}{i}" for i, w in enumerate(words)]
        rows.append((k, " ".join(words)))
        for j in range(3):  # chains of copies, some above and some below the limit
            words = list(words)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = f"changed{rng.random()}"
            rows.append((100 * (j + 1) + k, " ".join(words)))
    rows += [(0, "another text under a taken id, kept beside it"), (None, "no id"), (900, "No  id"), (901, "no id")]
    sets = [set(simhash.shingles(t, 5)) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
    want = sorted(min(d for (d, _), g in zip(rows, group, strict=True) if g == x and d is not None) for x in set(group))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted((r.doc_id for r in got.collect() if r.doc_id is not None)) == want
    assert got.where("doc_id is null").count() == 1 and 60 < len(want) < 200
    by_prefix = jaccard.keep_first(df, small=1)
    assert sorted(r.doc_id for r in by_prefix.collect() if r.doc_id is not None) == want
    monkeypatch.setattr(jaccard, "FEW", 0)  # nothing is broadcast
    by_shuffle = jaccard.keep_first(df.withColumn("nothing", F.lit(None)))
    assert by_shuffle.columns == [*df.columns, "nothing"] and by_shuffle.schema["nothing"].dataType.simpleString() == "void"
    assert sorted(r.doc_id for r in by_shuffle.collect() if r.doc_id is not None) == want
    assert jaccard.keep_first(df.limit(0)).count() == 0


def test_near_dedup_compares_blocks_of_large_buckets(spark, monkeypatch):
    rng = random.Random(8)
    base, rows = [f"common{i}" for i in range(60)], []
    for k in range(60):  # all share a passage, so bands hold many that are apart
        own = [f"own{k // 2}x{i}" for i in range(25)]
        own[rng.randrange(25)] = f"changed{k}"
        rows.append((k, " ".join(base + own)))
    sets = [set(simhash.shingles(t, 5)) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(60), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df, made = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(jaccard, "BLOCK", 700)
    blocks = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda members, *a: made.append(members.count()) or blocks(members, *a))
    found = {tuple(r) for r in jaccard.groups(df, dense=0).select("node", "least_id", "component").collect()}
    assert made[0] and found == {tuple(r) for r in jaccard.groups(df, dense=1 << 30).select("node", "least_id", "component").collect()}
    # every pair of one bucket, in blocks, against brute force
    nodes = {r.least_id: r.node for r in jaccard.groups(df).collect()}
    members = spark.createDataFrame([(1, nodes[k], k) for k in nodes], "band long, node long, component long")
    texts = spark.createDataFrame([(nodes[k], t) for k, t in rows if k in nodes], "node long, text string")
    got = sorted({tuple(r) for r in blocks(members, texts, 5, 0.8, 42).collect()})
    assert got == sorted((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in near)


def test_near_dedup_gives_its_disk_back(spark, monkeypatch, tmp_path):
    """Many partitions of few rows: shuffle files go with each action, steps with the last."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p.name for d in dirs for p in Path(d).rglob("shuffle_*")}
    wide = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    swept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, there = {k: spark.conf.get(k) for k in [*wide, swept]}, files()
    df = spark.createDataFrame([(k, t) for k, t, *_ in corpus(60)] + [(100 + k, t) for k, t, *_ in corpus(60)], "doc_id long, text string")
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        got = jaccard.keep_first(df)
        ends = time.monotonic() + 20
        while files() - there and time.monotonic() < ends:  # they go in the background
            time.sleep(0.2)
        assert not files() - there
    finally:
        for k in wide:
            spark.conf.set(k, was[k])
    assert spark.conf.get(swept) == was[swept]
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["gone", "signed"]
    assert sorted(r.doc_id for r in got.collect()) == list(range(60)) and got.count() == 60
    # a round of components is stored over as many files as its rows need, and replaces the last
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert components.components(edges.repartition(40), base=f"{tmp_path}/near").where("component = 0").count() == 301
    assert len(list((tmp_path / "near").iterdir())) == 1


def test_shingle_hashes_are_those_of_the_shingles():
    import xxhash

    for text in (None, "", " \n", "One", "a b c d", "a b c d e", "Ä B\tc d\x0be f g", LONG):
        assert jaccard._hashes(text, 5, 42).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in simhash.shingles(text, 5)]


# --- 7: mixing


def test_raking_meets_its_marginals(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, t + (" | a" if rng.random() < 0.1 else ""), lang, s, n) for k, t, lang, s, n in corpus(500)], SCHEMA)
    for budget in (1.0, 0.3):
        m = mixing.mix(docs, alpha=0.7, budget=budget, rounds=30, shortfall=0).toPandas()
        m["got"] = m.prob * m.n_tokens
        assert m.prob.max() <= 1 and (budget == 0.3 or m.prob.max() == pytest.approx(1))
        assert m.got.sum() <= budget * m.n_tokens.sum() * 1.000001
        for d in ("source", "lang", "topic"):
            g = m.groupby(d)[["n_tokens", "got"]].sum()
            target = g.n_tokens**0.7 / (g.n_tokens**0.7).sum()
            assert (g.got / g.got.sum()).tolist() == pytest.approx(target.tolist(), rel=1e-9)
            assert m.groupby(d)[f"t_{d}"].first().tolist() == pytest.approx(target.tolist())
        assert m.residual.max() < 1e-9
    assert abs(m.sampled.mean() - m.prob.mean()) < 0.08
    again = mixing.mix(docs.repartition(7), alpha=0.7, budget=0.3, shortfall=0).toPandas().sort_values("doc_id")
    assert again.sampled.tolist() == m.sort_values("doc_id").sampled.tolist()
    kept = mixing.keep_sampled(docs, alpha=0.7, budget=0.3, shortfall=0).toPandas()
    assert sorted(kept.doc_id) == sorted(m[m.sampled].doc_id)


def test_a_rare_cell_costs_little(spark):
    rows = corpus(800)
    kept = []
    for docs in (rows, [*rows, (90_000, "two words", "zz", "rare", 9)]):
        m = mixing.mix(spark.createDataFrame(docs, SCHEMA)).toPandas()
        got = m.prob * m.n_tokens
        kept.append(got.sum() / m.n_tokens.sum())
        for d in ("source", "lang", "topic"):
            share = got.groupby(m[d]).sum() / got.sum()
            off = (share - m.groupby(d)[f"t_{d}"].first()).abs()
            assert off.max() < 0.01 and (m.residual.max() + 1e-12 >= off.max())
    assert abs(kept[0] - kept[1]) < 0.01 and m.prob[m.lang == "zz"].tolist() == [1.0]


def test_mixing_of_many_cells_joins_sums(spark):
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    few, many = ({r.doc_id: r.prob for r in mixing.mix(docs, rounds=2, max_cells=n).collect()} for n in (100, 0))
    assert many == pytest.approx(few)


def test_mixing_to_given_targets(spark):
    docs = spark.createDataFrame(corpus(400), SCHEMA)
    want = spark.createDataFrame([("aa", 0.25), ("bb", 0.75)], "value string, share double")
    m = mixing.mix(docs, targets={"lang": want}).toPandas()
    got = (m.prob * m.n_tokens).groupby(m.lang).sum()
    assert (got / got.sum()).to_dict() == pytest.approx({"aa": 0.25, "bb": 0.75})
    # what cannot be met is said: the only topic cannot be half of all
    half = spark.createDataFrame([("prose", 0.5)], "value string, share double")
    assert mixing.mix(docs, targets={"topic": half}, rounds=3).agg(F.max("residual")).first()[0] > 0.1


def test_mixing_of_awkward_tables(awkward, empty):
    m = mixing.mix(awkward).collect()
    assert len(m) == len(AWKWARD) and all(r.prob == 0 and not r.sampled for r in m if r.n_tokens == 0)
    assert all(0 <= r.prob <= 1 for r in m) and mixing.mix(empty).count() == 0 and mixing.keep_sampled(empty).count() == 0
    clash = awkward.withColumns({c: F.lit("x") for c in ("prob", "topic_", "c_topic")})
    kept = mixing.keep_sampled(clash, alpha=1.0)  # the targets are the shares there are: all stay
    assert kept.columns == clash.columns and kept.count() == sum(r.n_tokens > 0 for r in m)
    assert mixing.mix(awkward.where("doc_id < 4")).where("sampled").count() == 0


# --- 8: chat


def test_chat_reads_back(spark):
    rng = random.Random(6)
    odd = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn|>user<|text|>", "\\b\\l\\", "", None, "é" * 900, "<", "\n"]
    rows = []
    for c in range(60):
        n = rng.randint(1, 14)
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", None, "t<o\\ol"])
            rows.append((c, t, role, rng.choice(odd) if rng.random() < 0.5 else "word " * rng.randint(1, 200)))
    rows += [(None, 0, "user", "x"), (99, None, "assistant", "y"), (99, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    w = chat.windows(df, budget=300, history=80)
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    shown = w.collect()
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars, g.formatted_chars) == (len(own), len(loss), sum(len(x.formatted) for x in shown if x.conv_id == c))
        assert (g.turns_sha256, g.loss_sha256) == (hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    assert any(x.n_repeated for x in shown)
    for x in shown:
        lines = x.formatted.split(chat.END)[:-1]
        assert len(lines) == x.n_turns and all(y.startswith(chat.TURN) for y in lines)
        size = list(map(line_tokens, lines))
        assert x.n_tokens == sum(size) and (x.n_tokens <= 300 or len(lines) == 1)
    assert chat.windows(df.limit(0)).count() == 0


def line_tokens(line):
    """Bytes of role and text as they stand in the line, and four for the control strings."""
    return len(line.encode()) - len(chat.TURN) - len(chat.TEXT) + 4


def test_chat_of_one_long_conversation(spark):
    """Work follows the turns, not turns x windows."""
    n = 40_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "user").otherwise("agent").alias("role"), F.lpad(F.col("id").cast("string"), 200, "x").alias("text"))
    began = time.monotonic()
    got = chat.windows(turns).select("window", "first_turn", "last_turn", "n_repeated", "n_turns", "n_tokens").orderBy("window").collect()
    assert time.monotonic() - began < 20
    assert got[0].first_turn == 0 and got[-1].last_turn == n - 1 and all(r.n_tokens <= 3072 for r in got)
    assert all(b.first_turn == a.last_turn + 1 for a, b in itertools.pairwise(got))
    assert all(r.n_turns - r.n_repeated == r.last_turn - r.first_turn + 1 for r in got)
    assert all(r.n_repeated == 4 for r in got[2:])  # the system turn, and three of 208 or 209 before


def test_chat_windows_keep_the_whole_budget(spark):
    """The sum over all turns of every window, against a plain reading of the rule."""
    rng, rows = random.Random(9), [(0, 0, "user", "a" * 200), (0, 1, "assistant", "b" * 8000)]
    for c in range(1, 80):
        rows += [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), rng.choice("w<é\\") * rng.choice([0, 1, 10, 50, 180, 280, 800])) for t in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((300, 80), (300, 280), (300, 0)):
        w = chat.windows(df, budget=budget, history=history)
        shown, own = w.collect(), {}
        for x in sorted(shown, key=lambda x: (x.conv_id, x.window)):
            lines = x.formatted.split(chat.END)[:-1]
            size = list(map(line_tokens, lines))
            assert x.n_tokens == sum(size) and (sum(size) <= budget or len(lines) == 1)
            system = rows_of(rows, x.conv_id)[0][1] == "system" and x.first_turn > 0
            spared = system and lines[0].startswith(chat.TURN + "system")
            assert sum(size[int(spared) : x.n_repeated]) <= history
            mine = sum(size[x.n_repeated :])
            if system:  # repeated wherever it fits
                assert spared == (mine + line_tokens(chat_line(*rows_of(rows, x.conv_id)[0][1:])) <= budget)
            # no turn more of the history would have fitted
            left = budget - mine - (size[0] if spared else 0)
            before = [line_tokens(chat_line(r, t)) for _, r, t in rows_of(rows, x.conv_id)[int(system) : x.first_turn]]
            most = 0
            while left >= 0 and (spared or not system) and most < len(before) and sum(before[len(before) - most - 1 :]) <= min(history, left):
                most += 1
            assert x.n_repeated - int(spared) == most
            own.setdefault(x.conv_id, []).extend(range(x.first_turn, x.last_turn + 1))
        assert all(own[c] == list(range(sum(r[0] == c for r in rows))) for c in range(80))
        assert any(x.n_repeated > 1 for x in shown) or not history
        got = {r.conv_id: r.turns_sha256 for r in chat.digests(w).collect()}
        assert all(got[c] == hashlib.sha256("".join(f"{r}\n{x}\n" for k, _, r, x in rows if k == c).encode()).hexdigest() for c in got)


def rows_of(rows, conv):
    return [r[1:] for r in rows if r[0] == conv]


def chat_line(role, text):
    guard = lambda x: x.replace("\\", "\\b").replace("<", "\\l")
    return chat.TURN + guard(role) + chat.TEXT + guard(text)


def test_chat_tokens_bound_those_of_a_vocabulary(spark, vocabulary):
    own, texts = bpe.ByteBPE(vocabulary), ["", "plain words", "naïve 一二三 😀 <tag> \\ back", "x" * 500]
    df = spark.createDataFrame([("us<er", t) for t in texts], "role string, text string")
    got = [r[0] for r in df.select(chat.turn_tokens(F.col("role"), F.col("text"))).collect()]
    for t, n in zip(texts, got, strict=True):
        role, text = (x.replace("\\", "\\b").replace("<", "\\l") for x in ("us<er", t))
        assert len(own.encode(role)) + len(own.encode(text)) + 4 <= n


# --- 9: sharding


def test_shards_are_even_gapless_and_only_the_new_one_gains(spark, awkward, empty):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    s = sharding.assign(docs).toPandas()
    assert sorted(s.shard.unique()) == list(range(8)) and s.groupby("shard").size().between(600, 900).all()
    for _, g in s.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = s[s.shard != s.grown_shard]
    assert set(moved.grown_shard) == {8} and 500 < len(moved) < 850
    assert (s["size"] == s.doc_id.astype(str).str.len() + 3).all()
    assert s.text_crc32.tolist() == [zlib.crc32(f"é{k}".encode()) for k in s.doc_id]
    few = {r.doc_id: r for r in sharding.assign(awkward).collect()}
    assert (few[1]["size"], few[1].text_crc32, few[1].law) == (1, 0, "key") and sharding.assign(awkward).count() == len(AWKWARD)
    assert sharding.assign(empty).count() == 0


def plain_shard(key, weights):
    """The earliest strike that counts by plain hashing: 2 shards a rack, 2 racks a region."""
    import struct

    import xxhash

    def unit(t, low, what, x):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        for part in (struct.pack("<i", t), struct.pack("<d", low), what.encode(), struct.pack("<i", x)):
            h = xxhash.xxh64_intdigest(part, h)
        return (h >> 11) / 2**53

    best = (math.inf, -1)
    zones = [(0, 1)] + [(1 << k, 1 << k) for k in range(12)]
    for first, n in zones:
        most, low, high = max(weights[4 * first : 4 * (first + n)], default=0), 0.0, 1.0
        while low < most:
            at = 0.0
            for t in itertools.count():
                at -= math.log(1 - unit(t, low, "clock", first)) / (4 * n * (high - low))
                if at >= best[0]:
                    break
                g = first + int(unit(t, low, "region", first) * n)
                r = 2 * g + int(unit(t, low, "rack", g) * 2)
                s = 2 * r + int(unit(t, low, "shard", r) * 2)
                if s < len(weights) and low + unit(t, low, "height", s) * (high - low) < weights[s]:
                    best = (at, s)
                    break
            low, high = high, 2 * high
    return best[1]


def test_descent_equals_plain_hashing(spark):
    trees = {"one": (1, {}), "eight": (8, {}), "eleven": (11, {}), "many": (70, {2: 5.0, 3: 0.0, 40: 0.25}), "light": (6, {k: 0.01 for k in range(6)})}
    keys = spark.range(600).select("id", *(sharding.pick(sharding.tree(n, weights=w), F.col("id")).alias(x) for x, (n, w) in trees.items()))
    for r in keys.collect():
        assert all(r[x] == plain_shard(str(r.id), [w.get(s, 1.0) for s in range(n)]) for x, (n, w) in trees.items())


def test_weights_move_rows_of_their_leaf_only(spark):
    keys = spark.range(8000).select("id")
    pick = lambda w, n=8: sharding.pick(sharding.tree(n, weights=w), F.col("id"))
    r = keys.select(pick({}).alias("a"), pick({3: 3.0}).alias("b"), pick({3: 0.0}).alias("c"), pick({5: 2.0, 4: 0.5}).alias("d")).toPandas()
    assert set(r[r.a != r.b].b) == {3} and abs((r.b == 3).mean() - 0.3) < 0.03
    assert set(r[r.a != r.c].a) == {3} and (r.c != 3).all()
    # by subtree: shards 4 and 5 are rack 2 of region 1; nothing else moves
    moved = r[r.a != r.d]
    assert ((moved.d == 5) | (moved.a == 4)).all() and set(r[~r.a.isin([4]) & ~r.d.isin([5])].eval("a == d")) == {True}


def test_every_growth_takes_rows_only_into_the_new_shard(spark):
    keys = spark.range(4000).select(*(sharding.pick(sharding.tree(n), F.col("id")).alias(f"s{n}") for n in range(1, 20))).toPandas()
    for n in range(1, 19):
        a, b = keys[f"s{n}"], keys[f"s{n + 1}"]
        assert set(b[a != b]) == {n} and abs((a != b).mean() - 1 / (n + 1)) < 0.03
    region, rack = sharding.place_of(sharding.tree(32), F.col("id").cast("int"))
    assert [tuple(x) for x in spark.range(32).select(region, rack).collect()] == [(s // 4, s // 2) for s in range(32)]
    for bad in ((0, {}), (-1, {}), (2, {0: 0.0, 1: 0.0}), (2, {0: -1.0}), (2, {0: math.inf})):
        with pytest.raises(ValueError):
            sharding.tree(bad[0], weights=bad[1])


def test_any_number_of_shards_and_any_weight(spark):
    for n, w in ((32, {}), (33, {7: 5.0}), (1000, {0: 5.0})):
        ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
        s = sharding.assign(ids, n, weights=w).toPandas()
        moved, total = s[s.shard != s.grown_shard], n - len(w) + sum(w.values())
        assert s.shard.between(0, n - 1).all() and set(moved.grown_shard) == {n}
        assert abs(len(moved) - 20_000 / (total + 1)) < 5 * math.sqrt(20_000 / total)
        sizes = s.groupby("shard").size().reindex(range(n), fill_value=0)
        for k, size in sizes.items():
            mean = 20_000 * w.get(k, 1.0) / total
            assert abs(size - mean) < 5.5 * math.sqrt(mean) + 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in s.groupby("shard"))


def test_shards_on_disk(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("own").alias("shard"))
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.where(F.col("_shard") != sharding.pick(sharding.tree(4), F.col("doc_id"))).count() == 0
    assert back.where("shard = 'own'").count() == 200


# --- 10: fertility


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_counts_equal_brute_force(spark, pieces):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["a", "b", "cc|", "d\n", "e#"]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", " \n", "x\x85y z\x1c", LONG[:4000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.judge(df, pieces).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i : i + 8]), []).append(i)
        repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_noise_is_rejected_and_prose_is_kept(spark, pieces):
    rng = random.Random(3)
    rows = [(k, t, lang) for k, t, lang, *_ in corpus(600) if len(t.split()) >= 20]
    # as many tokens as prose of the same length class, all of them bytes
    rows += [(1000 + k, " ".join(chr(rng.randint(0x1F300, 0x1F5FF)) for _ in range(30)), "aa") for k in range(5)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), pieces, group=F.col("lang")).collect()}
    prose = [r for k, r in got.items() if k < 1000 and not r.base_failed]
    assert sum(r.kept for r in prose) >= 0.99 * len(prose) > 100
    assert not any(got[1000 + k].kept or got[1000 + k].base_failed for k in range(5))


def plain_bands(rows):
    """(level, group, class) -> rate -> (low, high), by sorting."""
    groups = {}
    for r in rows:
        if r["n_words"] >= 20:
            size = r["n_tokens"].bit_length() - 1
            for at in ((0, r["group_key"], size), (1, r["group_key"], None), (3, None, None)):
                groups.setdefault(at, []).append(r)
    out = {}
    for at, members in groups.items():
        if len(members) >= 50:
            out[at] = {}
            for rate in fertility.RATES:
                v = sorted(round(m[rate], 3) for m in members)
                lo, hi = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
                wide = 4 * max(hi - lo, fertility.FLOOR[rate])
                out[at][rate] = (lo - wide, hi + wide)
    return out


def test_rates_bands_and_verdicts_equal_brute_force(spark, pieces):
    import sentencepiece
    from collections import Counter

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read(), public_tokenizers.PATTERN
    rng = random.Random(5)
    rows = [(k, t, lang) for k, t, lang, *_ in corpus(500)] + [(900 + k, " ".join(rng.choice(["\U0001f300", "zz", "q1"]) for _ in range(40)), "bb") for k in range(9)] + [(950, None, "aa"), (951, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, second, want = sentencepiece.SentencePieceProcessor(model_proto=pieces), fertility.second_encoder(ranks), {}
    for k, t, lang in rows:
        words = (t or "").split()
        ids = [i for w in words for i in model.encode(w)]
        n, chars = len(ids), sum(map(len, words))
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) / (math.log2(n) if n > 1 else 1) if n > 1 else float(n)
        want[k] = {
            "group_key": lang or "none", "n_words": len(words), "n_tokens": n, "chars_per_token": chars / n if n else 0.0, "byte_share": sum(map(model.is_byte, ids)) / n if n else 0.0,
            "token_entropy": entropy, "chars_per_token_multi": chars / sum(len(second(" " + w)) for w in words) if words else 0.0,
        }
    limits = plain_bands(want.values())
    assert {at[0] for at in limits} == {0, 1, 3}
    for parts in (1, 9):
        got = {r.doc_id: r for r in fertility.judge(df.repartition(parts), pieces, group=F.col("lang"), ranks=ranks).collect()}
        for k, w in want.items():
            r = got[k]
            assert all(r[c] == pytest.approx(w[c]) for c in w if c != "group_key")
            b = next((limits[at] for at in ((0, w["group_key"], w["n_tokens"].bit_length() - 1), (1, w["group_key"], None), (3, None, None)) if at in limits), None)
            inside = all((c == "byte_share" or w[c] >= b[c][0]) and (c == "token_entropy" or w[c] <= b[c][1]) for c in fertility.RATES)
            assert r.kept == (inside and not r.base_failed)


def test_words_of_many_texts_are_encoded_together(pieces):
    import sentencepiece

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read(), public_tokenizers.PATTERN
    model, second = sentencepiece.SentencePieceProcessor(model_proto=pieces), fertility.second_encoder(ranks)
    calls = []

    class Counted:
        def encode(self, texts, **kw):
            calls.append(len(texts))
            return model.encode(texts, **kw)

    rng = random.Random(6)
    odd = ["it's", "'t", "a\xa0", "\xa0", "\xa0b", "\x85x\x1c", "\u3000", "12a", "\u2581", "e\u0301", "\u0301", "\xad", "a" * 500, "\U0001f300!?", "<|endoftext|>", "ka", "mo,"]
    texts = [" ".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    made, words = fertility.all_measures(texts, None, fertility._Words(Counted(), fertility.second_sizes(ranks)), np.zeros(model.get_piece_size(), bool), 1 << 20)
    assert len(calls) == 1 and calls[0] == len(words) == len(odd)
    assert [len(m) for m in made] == [len(fertility.COUNTS + fertility.RATES)] * len(texts)
    for w, k in words.items():
        assert words.tokens[words.start[k] : words.start[k + 1]].tolist() == model.encode(w.decode())
        assert words.second[k] == len(second(" " + w.decode()))
    # words without white space of their own are read as one text
    plain = [x for x in odd if len(x.split()) == 1 and x.split()[0] == x]
    assert fertility.second_sizes(ranks)(plain, " ".join(plain)).tolist() == [len(second(" " + x)) for x in plain]
    # tables of few words begin anew, with the same measures
    again, _ = fertility.all_measures(texts, lambda: fertility._Words(model, fertility.second_sizes(ranks)), fertility._Words(model, fertility.second_sizes(ranks)), np.zeros(model.get_piece_size(), bool), 5, 40)
    assert again == made


def test_fertility_of_awkward_tables(awkward, empty, pieces):
    out = fertility.judge(awkward, pieces, group=F.col("lang")).collect()
    assert len(out) == len(AWKWARD) and fertility.judge(empty, pieces).count() == 0
    assert fertility.keep_good(awkward, pieces).columns == awkward.columns


# --- the registered queries

CONTRACT = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_hamming_top_k": ["query_id", "rank", "vec_id", "distance"],
    "op4_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_html_main_text": ["page_id", "url", "text", "n_chars"],
    "op6_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op7_mixing": ["doc_id", "source", "lang", "topic"],
    "op8_chat_windows": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_hash_tree_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_tokeniser_fertility": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op11_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op12_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", CONTRACT)
def test_registered_query(spark, name):
    import duckdb

    from ledgerlens.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    assert df.columns[: len(CONTRACT[name])] == CONTRACT[name]
    got = df.collect()
    ids = {"op5": ("pages", "page_id"), "op8": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    if name == "op12_conversation_repair":
        assert sorted(r.conv_id for r in got) == sorted(x[0] for x in con.execute("SELECT DISTINCT conv_id FROM conversations").fetchall())
    elif name not in ("op3_hamming_top_k", "op13_hard_negatives"):
        want = con.execute(f"SELECT {ids[1]} FROM {ids[0]}").fetchall()
        want = sorted({x[0] for x in want} | {-7}) if name == "op8_chat_windows" else sorted(x[0] for x in want)
        assert sorted(r[ids[1]] for r in got) == want
    if name in ("op1_toxicity", "op2_language_id"):
        n, k = (5, 0) if name == "op1_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) and 0 <= r.score <= 1 for r in got)
    sql = queries.oracle_sql().get(name)
    if sql:
        rows = con.execute(sql)
        at = [c[0] for c in rows.description]
        assert sorted(at) == sorted(df.columns)
        norm = lambda r: tuple(round(x, 8) if isinstance(x, float) else x for x in r)
        assert sorted(map(repr, map(norm, rows.fetchall()))) == sorted(repr(norm(r[c] for c in at)) for r in got)


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_corpus(500)
    rows += [(1000 + k, t, lang, s, n) for k, (_, t, lang, s, n) in enumerate(rows[:50])] + [(2000, None, None, None, None), (2001, "123 456", "aa", "src0", 7)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == columns or k == 4
    assert seen[0] == {r[0] for r in rows} - {2000, 2001}
    bad = {d for d, _, t in labels if t}
    bad |= {1000 + d for d in bad if d < 50}
    assert len(seen[0] - seen[1] - bad) <= 12 and len(bad & seen[1]) <= 12
    assert not any(1000 + k in seen[2] for k in range(50) if k in seen[1])
    assert seen[2] >= seen[3] == seen[4] and len(seen[3]) > 0.5 * len(seen[2])
