"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A pre-token's adjacent pairs are the leaves; each node holds the least (rank, position) of
the pairs below it, so the root is the leftmost pair of lowest rank. A merge updates
the two or three leaves around it and their paths, which takes O(log n), until no pair at
the root can be merged. Pre-tokens repeat, so each worker keeps what it has encoded.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, lean, sliced

#: Pre-tokens of the byte-level scheme: contractions, then runs of letters, numbers and
#: others with at most one space before, then white space. White space is the Unicode
#: property, which leaves out U+001C to U+001F.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible in
    Latin-1, else the next free character from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


#: A leaf of the tree is rank, position and merged symbol in one integer, in that order, so
#: that the least leaf is the leftmost pair of the lowest rank and tells what it becomes.
_ID_BITS, _AT_BITS = 20, 32
_ID, _AT = (1 << _ID_BITS) - 1, (1 << _AT_BITS) - 1
_NONE = 1 << 120


def merged(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """The symbols of one pre-token after all merges: lowest rank first, leftmost first.
    pairs maps left << 20 | right to rank << 52 | merged symbol."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree, get = [_NONE] * (2 * size), pairs.get
    left = symbols[0]
    for i in range(n - 1):
        right = symbols[i + 1]
        key = get(left << _ID_BITS | right)
        if key is not None:
            tree[size + i] = key | i << _ID_BITS
        left = right
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != _NONE:
        i = least >> _ID_BITS & _AT
        j = after[i]
        symbols[i] = least & _ID
        symbols[j] = -1
        k = after[i] = after[j]
        h = before[i]
        changed = [(i, _NONE)]
        if k < n:
            before[k] = i
            key = get(symbols[i] << _ID_BITS | symbols[k])
            if key is not None:
                changed = [(i, key | i << _ID_BITS)]
            changed.append((j, _NONE))
        elif j < n - 1 or j < size:
            changed.append((j, _NONE))
        if h >= 0:
            key = get(symbols[h] << _ID_BITS | symbols[i])
            changed.append((h, _NONE if key is None else key | h << _ID_BITS))
        for at, key in changed:
            at += size
            if tree[at] == key:
                continue
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
    return [s for s in symbols if s >= 0]


class _Pieces(dict):
    """Pre-token -> (number of ids, ids joined by commas, their bytes), made when missed;
    what an older generation knew is taken over."""

    def __init__(self, codec: ByteBPE, older: dict) -> None:
        self.codec, self.older = codec, older

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        found = self.older.get(piece)
        if found is None:
            c = self.codec
            ids = merged([c.byte_ids[b] for b in piece.encode()], c.pairs)
            found = (len(ids), ",".join(map(str, ids)), b"".join(map(c.bytes_of.__getitem__, ids)))
        if len(piece) <= 64:
            self[piece] = found
        return found


class _Ids(dict):
    """Pre-token -> its ids as 32-bit integers, made when missed: smaller than what _Pieces
    keeps, for work that needs neither decimals nor decoded bytes."""

    def __init__(self, codec: ByteBPE, older: dict) -> None:
        self.codec, self.older = codec, older

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            c = self.codec
            found = array("i", merged([c.byte_ids[b] for b in piece.encode()], c.pairs)).tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


class ByteBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, source: str, known: int = 400_000, known_ids: int = 100_000) -> None:
        import regex

        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        if max(vocab.values()) > _ID:
            raise ValueError("ids of up to 20 bits are supported")
        self.pairs = {vocab[a] << _ID_BITS | vocab[b]: rank << _ID_BITS + _AT_BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        shown = byte_symbols()
        back = {c: b for b, c in enumerate(shown)}
        self.byte_ids = [vocab[c] for c in shown]
        self.bytes_of = {i: bytes(back[c] for c in piece) for piece, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # two generations: what is used again survives when the younger one is full
        self.known, self.known_ids = known // 2, known_ids // 2
        self.cache, self.ids_cache = _Pieces(self, {}), _Ids(self, {})

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, the text that the ids decode to)."""
        if len(self.cache) > self.known:
            self.cache.older = {}
            self.cache = _Pieces(self, self.cache)
        got = []
        for k, part in enumerate(self.stops.split(text) if self.stops else [text]):
            if k % 2:
                got.append((1, str(self.special[part]), part.encode()))
            elif part:
                got.extend(map(self.cache.__getitem__, self.pieces.findall(part)))
        if not got:
            return 0, "", ""
        sizes, ids, raw = zip(*got, strict=True)
        return sum(sizes), ",".join(ids), b"".join(raw).decode("utf-8", "replace")

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        got = []
        for k, part in enumerate(self.stops.split(text) if self.stops else [text]):
            if k % 2:
                got.append(array("i", [self.special[part]]).tobytes())
                continue
            # a text can have more different pre-tokens than a generation holds
            pieces = self.pieces.findall(part)
            for at in range(0, len(pieces), 4096):
                if len(self.ids_cache) > self.known_ids:
                    self.ids_cache.older = {}
                    self.ids_cache = _Ids(self, self.ids_cache)
                got.extend(map(self.ids_cache.__getitem__, pieces[at : at + 4096]))
        return b"".join(got)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(source: str) -> ByteBPE:
    return ByteBPE(source)


def vocabulary(path: str) -> str:
    """The content of a vocabulary file on the driver; it is broadcast, so that executors
    need no copy of the file. Its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _coder(shared, digest: bool, names: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        batches = lean(batches)
        first = next(batches, None)  # earlier work's memory is given back before the codec takes its own
        if first is None:
            return
        codec = _codec(shared.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in sliced(itertools.chain([first], batches)):
            if digest:
                got = [codec.round_trip(x.as_py() or "") for x in batch.columns[-1]]
                made = [pa.array([x[0] for x in got], pa.int64()), pa.array([sha(x[1]) for x in got], pa.string()), pa.array([sha(x[2]) for x in got], pa.string())]
            else:
                got = [codec.packed(x.as_py() or "") for x in batch.columns[-1]]
                sizes = np.array([len(x) // 4 for x in got], np.int64)
                ends = np.cumsum([0, *sizes], dtype=np.int32)
                made = [pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    return run


def _apply(rows: DataFrame, text: Column, source: str, added: list[StructField], digest: bool) -> DataFrame:
    schema = StructType([*rows.schema.fields, *added])
    shared = rows.sparkSession.sparkContext.broadcast(source)
    fed = rows.select("*", text.cast("string").alias(fresh("text_", schema.names)))
    return fed.mapInArrow(_coder(shared, digest, schema.names), schema)


def encode(docs: DataFrame, source: str, text_col: str = "text", ids: str = "token_ids", size: str = "n_tokens") -> DataFrame:
    """docs with the token ids of each whole text and their number.

    Null texts are encoded like empty ones: no ids. A special token's string in a text is
    that token. Existing columns of the new names keep theirs: the new ones get a ``_``.
    """
    from pyspark.sql.types import ArrayType, IntegerType

    n = fresh(size, docs.columns)
    i = fresh(ids, [*docs.columns, n])
    return _apply(docs, F.col(text_col), source, [StructField(n, LongType()), StructField(i, ArrayType(IntegerType(), True))], False)


def round_trip_digests(docs: DataFrame, source: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: the digests of the
    decimal ids joined by commas and of the text decoded from them."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(source)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coder(shared, True, names), schema)


def decode(encoded: DataFrame, source: str, ids: str = "token_ids", into: str = "text") -> DataFrame:
    """encoded with the text that each row's ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(source)
    into = fresh(into, encoded.columns)
    schema = StructType([*encoded.schema.fields, StructField(into, StringType())])
    at = encoded.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        codec = _codec(shared.value)
        for batch in sliced(batches):
            texts = [codec.decode(x or []) for x in batch.columns[at].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
