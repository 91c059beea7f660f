"""Token files, conversation repair and hard negatives against brute force and awkward tables."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import negatives, packing, repair

np = pytest.importorskip("numpy")
public_tokenizers = pytest.importorskip("public_tokenizers")


# --- 11: token files


@pytest.fixture(scope="module")
def source():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_is_exact_at_every_width(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    raw = packing.pack(ids, bits)
    assert len(raw) == -(-1003 * bits // 8)
    assert (packing.unpack(raw, bits, 1003) == ids).all()
    assert all((packing.unpack(raw, bits, n, first) == ids[first : first + n]).all() for first, n in ((0, 1), (8, 77), (16, 0), (1000, 3)))


def test_packing_of_odd_places_and_too_wide_ids():
    ids = np.arange(500, dtype=np.uint32)
    assert (packing.unpack(packing.pack(ids, 9), 9, 41, 101) == ids[101:142]).all()
    with pytest.raises(ValueError):
        packing.pack(ids, 8)
    assert [packing.width(n) for n in (1, 2, 3, 256, 257, 32000, 50257, 65537)] == [1, 1, 2, 8, 9, 15, 16, 17]


def test_pieces_give_what_the_library_gives(source, library):
    import pyarrow as pa

    signs = ["a", "é", " ", "\n", " ", " ", "　", "<|endoftext|>", "!", "7", "\x1c", "\t", "\r\n", "\x85", "漢", "😀", "'s", "  ", "​", "᠎", "\x00", " ", "\x7f", "à", "؀", "᚟"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [None, "", "x" * 9000, "mot " * 3000]
    for known in (1_000_000, 50):  # the second forgets all the time
        encoder = packing.Encoder(source, known=known)
        assert encoder.by_piece
        for lo in range(0, len(texts), 1500):
            some = texts[lo : lo + 1500]
            ids, sizes = encoder.encode(pa.array(some, pa.string()))
            want = [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]
            assert sizes.tolist() == [len(w) for w in want]
            assert ids.tolist() == list(itertools.chain.from_iterable(want))


def test_other_vocabularies_get_whole_texts():
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    import pyarrow as pa

    texts = ["Hello  There", None, "naïve\ttext", ""]
    encoder = packing.Encoder(source)
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    want = [Tokenizer.from_str(source).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not encoder.by_piece and ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def check_files(spark, rows, source, library, path, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, ids_crc32 int").repartition(3)
    packing.write(docs, path, source, 2, **how)
    got = packing.read(spark, path).orderBy("start").collect()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.token_ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted((str(k), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t, *_ in rows)
    assert sorted((str(r.doc_id), r.token_ids) for r in got) == want
    whole = [i for r in got for i in r.token_ids]
    for lo, hi in ((0, len(whole)), (5, 5), (len(whole) // 3, len(whole) // 2)):
        assert packing.read_slice(spark, path, lo, hi).tolist() == whole[lo:hi]


def test_files_read_back(spark, source, library, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 90))), "x", 1) for k in rng.sample(range(-500, 5000), 300)]
    rows += [(None, "no id", None, None), (None, None, None, None), (7, None, "x", 1), (8, "", "x", 1), (8, "same id", "x", 1), (9, "word " * 20_000, "x", 1)] + [(6, "a repeated row", "x", 1)] * 150
    check_files(spark, rows, source, library, str(tmp_path / "a"), files=5, block=256)
    # short files: every range rolls over many
    check_files(spark, rows, source, library, str(tmp_path / "b"), files=3, block=64, file_ids=700, file_docs=20)
    parts = spark.read.parquet(str(tmp_path / "b" / "manifest")).collect()
    assert max(r.n_docs for r in parts) == 20 and len(parts) > 20


def test_files_of_no_documents(spark, source, tmp_path):
    packing.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), source, 2)
    assert packing.read(spark, str(tmp_path / "e")).columns == ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"]
    assert packing.read(spark, str(tmp_path / "e")).count() == 0
    assert len(packing.read_slice(spark, str(tmp_path / "e"), 0, 10)) == 0


def test_a_cut_file_is_told(spark, source, tmp_path):
    packing.write(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), str(tmp_path / "c"), source, 2, files=1)
    uri = packing.files_of(spark, str(tmp_path / "c")).first().uri
    with open(uri, "rb") as f:
        raw = f.read()
    with open(uri, "wb") as f:
        f.write(raw[:-9])
    from pyarrow import fs

    with pytest.raises(ValueError):
        packing.Reader(fs.LocalFileSystem().open_input_file(uri))


# --- 12: conversation repair


def all_edits(rows, limit=3):
    """(cost, audit, repaired rows) of the best edits: every choice for every row, and up to
    ``limit`` insertions at every place, the least one kept for what the roles spell."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    def spell(ways, role, cost, op, line):
        out = set()
        for c, a, t in ways:
            out.add((c + cost, a + op, (*t, line)))
        return out

    def prune(found):
        return {k: {min(v)} for k, v in found.items()}

    def legal(x):
        # a beginning of (s?(ua)+)?, shortened to what decides its continuations
        return {"": "", "s": "s", "u": "u", "su": "u", "ua": "a", "au": "u"}.get(x)

    ways = {"": {(0, "", ())}}  # what the roles so far spell -> the best way there
    for (role, text), fault in [*zip(rows, faults, strict=True), ((None, None), None)]:
        for _ in range(limit):
            more = {k: set(v) for k, v in ways.items()}
            for k, v in ways.items():
                for new in ("user", "assistant"):
                    to = legal(k + new[0]) if (k + new[0]) != "a" and k + new[0] not in ("aa", "uu", "sa") else None
                    if to:
                        more.setdefault(to, set()).update(spell(v, new, 5, "I", (new, "")))
            ways = prune(more)
        if role is None:
            break
        made = {}
        for k, v in ways.items():
            made.setdefault(k, set()).update((c + 2, a + "D", t) for c, a, t in v)
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault == "truncated" else 0
            for new, cost, op in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                i = new[:1]
                to = legal(k + i) if (k, i) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")) else None
                if to:
                    made.setdefault(to, set()).update(spell(v, new, cost + late, op, (new, text)))
        ways = prune(made)
    best = min(x for k in ("", "a") for x in ways.get(k, ()))
    return best, faults


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            rows.append((c, rng.choice([turn, turn, None, turn * 2]), role, rng.choice(["Yes.", "no", "Why?  ", "", " \n", None, "So it is! \t", "and then,"])))
    return rows


def test_repairs_equal_all_edits(spark):
    rows = conversations(400, 3) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in repair.digests(df, repair.plans(df)).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for c, some in by.items():
        some.sort()
        (cost, audit, lines), faults = all_edits([(r, t) for _, _, r, t in some])
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit), (some, r)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        assert [faults.count(f) for f in ("blank", "duplicate", "truncated")] == [r.blank, r.duplicate, r.truncated]
        turns = [t for known, t, _, _ in some if known]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        heads = [x[2][:1] for x in some]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(heads))
    out = {}
    for r in repair.repaired(df, repair.plans(df)).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.turn == len(out[r.conv_id]) - 1
    assert all(hashlib.sha256("\n".join(v).encode()).hexdigest() == got[k].repaired_sha256 for k, v in out.items())


def test_a_grammar_changes_no_result():
    rng = random.Random(9)
    plain, rich = repair.Grammar(()), repair.Grammar(("ua", "xx", chr(0x4E00) + chr(0x4E00), "sU", chr(0x4E02) + "a", chr(0x4E01) + chr(0x4E01)))
    for _ in range(300):
        s = "".join(rng.choice("suaoSUAOxxuaua") for _ in range(rng.randint(0, 60)))
        assert rich.expand(rich.compress(s)) == s
        assert rich.cheapest(s) == plain.cheapest(s)
    assert rich.cheapest("") == (0, "")
    cost, audit = rich.cheapest("ua" * 50_000 + "x" * 1000)
    assert cost == 2000 and audit == "K" * 100_000 + "D" * 1000


def test_ropes_compare_like_strings():
    rng = random.Random(1)

    def some(n):
        return rng.choice(["", "D", "K", "KR", "DD" * 40]) if n == 0 else repair.joined(some(n - 1), some(n - 1))

    for _ in range(400):
        a, b = some(rng.randint(0, 5)), some(rng.randint(0, 5))
        assert repair.before(a, b) == (repair.flat(a) < repair.flat(b))


def test_re_pair_finds_the_frequent_pairs(spark):
    df = spark.createDataFrame([("uaua",), ("uauaua",), ("suaua",), ("xx",)], "s string")
    rules = repair.repair_rules(df, "s")
    assert rules[0] == "ua" and chr(0x4E00) * 2 in rules
    assert repair.repair_rules(df.limit(0), "s") == ()


def test_repair_of_awkward_tables(spark):
    schema = "conv_id string, turn int, role string, text string, cost int"
    df = spark.createDataFrame([("a", 1, "user", "w " * 50_000 + ".", 1), ("a", 1, "user", "w " * 50_000 + ".", 1), ("b", None, None, None, None), ("c", 3, "assistant", "Hi.", 0)], schema)
    got = {r.conv_id: r for r in repair.digests(df, repair.plans(df)).collect()}
    assert [(got[c].audit, got[c].cost, got[c].duplicate, got[c].blank) for c in "abc"] == [("DD", 4, 1, 0), ("D", 2, 0, 1), ("D", 2, 0, 0)]
    none = repair.digests(df.limit(0), repair.plans(df.limit(0)))
    assert none.columns[0] == "conv_id" and none.count() == 0
    gone = df.withColumn("n", F.lit(0))
    r = repair.digests(gone, repair.plans(gone, copies="n"), copies="n").where("conv_id = 'a'").first()
    assert (r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_is_that_of_the_checksum(spark):
    rows = [(c, t, "assistant", "a.b!c?") for c in range(8) for t in (*range(8), None)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in repair.damaged(df).collect():
        k = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(k, 1)
        if r.conv_id is not None:
            assert (r.role, r.text) == ("user" if k == 4 else "assistant", {1: "", 2: "abc"}.get(k, "a.b!c?"))


# --- 13: hard negatives


def plain_negatives(rows, every=50):
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        usable[i] = min(usable.get(i, (label, v)), (label, v))
    q = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in usable.items()}
    out = []
    for a, (label, v) in q.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in q.items()}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))  # noqa: E731, B023
        for p in first(i for i in q if i != a and q[i][0] == label)[:5]:
            inside = first(i for i in q if q[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p])
            out += [(a, p, k, n, score[p], score[n]) for k, n in enumerate(inside[:3], 1)]
    return sorted(out)


def mined(spark, rows, every=50, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("v", F.lit(1)).withColumn("block_a", F.lit("x"))
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, **how).collect()))


def test_negatives_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 3), [rng.gauss(0.2, 1) for _ in range(12)]) for k in range(-40, 260)]
    rows = [(i, label, np.array(v, np.float32).tolist()) for i, label, v in rows]
    same = rows[50][2]
    rows += [(1000 + k, k % 3, same) for k in range(60)]  # ties
    rows += [(2000, None, same), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 12), (2050, 1, [float("inf")] * 12), (None, 1, same), (2100, 1, []), (2150, 2, [0.5]), (7, 1, same), (7, 1, same), (2200, 0, [1e20] * 12)]
    want = plain_negatives([r for r in rows if r[0] != 2200], 10)
    assert len(want) > 200
    assert mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, anchor_block=7, block=33) == want  # many cells


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.6]), (3, 2, [0.99])], every=50) == [(0, 1, 1, 2, 65536, 153 * 256)]


@pytest.mark.parametrize("dims,top", [(1, 4), (64, 256), (64, 30_000), (700, 5), (1536, 3000)])
def test_residues_give_exact_products(dims, top):
    rng = np.random.default_rng(dims)
    a, c = rng.integers(-top, top + 1, (5, dims)), rng.integers(-top, top + 1, (9, dims))
    a[0], c[0], c[1] = top, top, -top
    primes, columns = negatives.primes_for(dims * top * top, dims)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(c, primes), primes, columns)
    assert (got == a.astype(object) @ c.astype(object).T).all()
    assert all((p // 2) ** 2 * columns < 1 << 24 for p in primes)
