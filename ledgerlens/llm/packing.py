"""Token ids of a corpus as files of fixed-width bit-packed blocks, in document order.

A file is a header (magic, bits of an id, ids of a block), the blocks, the footer and a
trailer. A block holds its ids in the vocabulary's least number of bits, little-endian and
without gaps, and starts at a whole byte. The footer has the byte offset of every block, the
end of every document in ids, and the documents' keys; so any span of ids or any document is
read by its blocks alone and unpacked by numpy at once.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"LLIDS\x001\n"
_HEAD, _TAIL = struct.Struct("<8sII"), struct.Struct("<QQQ8s")


def width(n_ids: int) -> int:
    """Bits that hold the ids 0 to n_ids - 1."""
    return max(1, int(n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in so many bits each, the first in the lowest bits of the first byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, axis=None, bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """The n ids from place ``first`` on of a packed block: each is cut out of the five bytes
    around it, all at once."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    whole = np.frombuffer(raw + b"\0" * 5, np.uint8)
    out = np.zeros(n, np.uint64)
    for k in range(5):
        out |= whole[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Documents' ids into one open binary file; at most one block of ids waits in memory."""

    def __init__(self, out, bits: int, block: int) -> None:
        self.out, self.bits, self.block = out, bits, block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.at, self.offsets, self.ends, self.keys = _HEAD.size, [], [], []
        out.write(_HEAD.pack(MAGIC, bits, block))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.keys.append(key)
        if self.n_waiting >= self.block:
            joined = np.concatenate(self.waiting)
            full = len(joined) - len(joined) % self.block
            for k in range(0, full, self.block):
                self._put(joined[k : k + self.block])
            self.waiting, self.n_waiting = [joined[full:]], len(joined) - full

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        for part in (np.array([*self.offsets, self.at], "<u8"), np.array(self.ends, "<u8"), keys, null):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(self.n_ids, len(self.ends), self.at, MAGIC))
        self.out.close()


class Reader:
    """One file, by random access; only the footer stays in memory."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        magic, self.bits, self.block = _HEAD.unpack(self._at(0, _HEAD.size))
        self.n_ids, self.n_docs, foot, end = _TAIL.unpack(self._at(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a file of packed ids, or not a whole one")
        raw = self._at(foot, size - _TAIL.size - foot)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1)
        self.ends = np.frombuffer(raw, "<u8", self.n_docs, 8 * (n_blocks + 1)).astype(np.int64)
        self.keys = np.frombuffer(raw, "<i8", self.n_docs, 8 * (n_blocks + 1 + self.n_docs))
        self.null = np.frombuffer(raw, np.uint8, self.n_docs, 8 * (n_blocks + 1 + 2 * self.n_docs)).astype(bool)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def span(self, lo: int, hi: int) -> np.ndarray:
        """The ids from place lo to before hi: reads the blocks that hold them."""
        if not 0 <= lo <= hi <= self.n_ids:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        raw, base, got = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first])), int(self.offsets[first]), []
        for b in range(first, last + 1):
            a, z = max(lo - b * self.block, 0), min(hi - b * self.block, self.block)
            got.append(unpack(raw[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], self.bits, z - a, a))
        return np.concatenate(got)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self, ids: int = 1 << 20):
        """(place in the file, ids) of all documents in order, read some blocks at a time."""
        k = 0
        while k < self.n_docs:
            lo = int(self.ends[k - 1]) if k else 0
            z = max(k + 1, int(np.searchsorted(self.ends, lo + ids, "right")))
            some = self.span(lo, int(self.ends[z - 1]))
            for d in range(k, z):
                a = int(self.ends[d - 1]) if d else 0
                yield d, some[a - lo : int(self.ends[d]) - lo]
            k = z


# --- encoding


def _breaks(raw: np.ndarray) -> np.ndarray:
    """Places where a blank or line feed follows a character that is not white space. No
    pre-token of the byte-level scheme crosses such a place, and none depends on what is
    beyond it, so the pieces between can be encoded one by one."""
    one, two, three = raw[:-1], np.concatenate(([0], raw[:-2])), np.concatenate(([0, 0], raw[:-3])) if len(raw) > 2 else np.zeros(len(raw) - 1, np.uint8)
    end = (one >= 0x21) & (one != 0x7F)
    # the white space above ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    end &= ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    end &= ~((three == 0xE1) & (two == 0x9A) & (one == 0x80))
    end &= ~((three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)))
    end &= ~((three == 0xE2) & (two == 0x81) & (one == 0x9F))
    end &= ~((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return np.flatnonzero(end & ((raw[1:] == 0x20) | (raw[1:] == 0x0A))) + 1


class Encoder:
    """Texts to ids by the tokenizers library.

    With a plain byte-level vocabulary each different piece of a batch (a word and the blanks
    before it) is encoded once, and frequent ones are remembered; with any other the library
    gets whole texts.
    """

    def __init__(self, source: str, known: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(source)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.by_piece = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        shown = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(1 + max(shown.values()), np.int64)
        special = {t["content"] for t in added}
        for piece, i in shown.items():  # a byte is one character of a byte-level piece
            self.bytes_of[i] = len(piece.encode()) if piece in special else len(piece)
        self.known, self.places, self.table, self.used = known, {}, np.zeros(1 << 16, np.uint32), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of each text's)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces. Those that start with a blank or line feed and end with a
        character that is not white space go to the library as one text, since the places
        where they meet are breaks; the bytes of the ids tell them apart."""
        glued = [p[0] in b" \n" and (0x20 < p[-1] < 0x7F or p[-1] > 0x7F and not p.decode()[-1].isspace()) for p in pieces]
        some, rest = [p for p, g in zip(pieces, glued, strict=True) if g], [p.decode() for p, g in zip(pieces, glued, strict=True) if not g]
        ids, _ = self._library([b"".join(some[k : k + 4096]).decode() for k in range(0, len(some), 4096)])
        at = np.concatenate(([0], np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p) for p in some]), "left") + 1)) if some else np.zeros(1, np.int64)
        more, sizes = self._library(rest)
        starts, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        glued = np.array(glued, bool)
        starts[glued], n[glued] = at[:-1], np.diff(at)
        starts[~glued], n[~glued] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate((ids, more)), np.stack((starts, n), 1)

    def _remember(self, pieces: list[bytes]) -> np.ndarray:
        """(start, length) in the table of each piece's ids."""
        if len(self.places) > self.known:  # the table starts anew when it is full
            self.places, self.used = {}, 0
        places = self.places
        new = [p for p in pieces if p not in places]
        if new:
            ids, at = self._pieces(new)
            if self.used + len(ids) > len(self.table):
                self.table = np.concatenate((self.table[: self.used], np.zeros(max(len(self.table), len(ids)), np.uint32)))
            self.table[self.used : self.used + len(ids)] = ids
            places.update(zip(new, (at[:, 0] + self.used << 32 | at[:, 1]).tolist(), strict=True))
            self.used += len(ids)
        got = np.fromiter(map(places.__getitem__, pieces), np.int64, len(pieces))
        for p in new:  # long ones seldom come again
            if len(p) > 64:
                del places[p]
        return got >> 32, got & 0xFFFFFFFF

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, the number of each text's ids); texts is an Arrow array of
        strings, null as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_piece:
            return self._library(texts.to_pylist())
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        lo, hi = int(off[0]), int(off[-1])
        if hi == lo:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo)
        ends = np.sort(np.concatenate((_breaks(raw), off - lo)), kind="stable")
        ends = ends[np.concatenate(([True], np.diff(ends) > 0))]
        data = pa.py_buffer(raw)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), data])
        coded = pieces.dictionary_encode()
        starts, sizes = self._remember(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        each = sizes[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = self.table[np.repeat(starts[which] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(ends, off - lo)])


def _by_bytes(batches, most: int = 1 << 22):
    """Batches of (key, text) in slices of up to so many bytes of text, or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[1]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


@lru_cache(maxsize=2)
def _encoder(source: str) -> Encoder:
    return Encoder(source)


# --- on Spark


def _store(uri: str):
    """(file system, path) for a URI or an absolute path, on whichever store it names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANIFEST = "part long, piece long, name string, n_docs long, n_ids long"


def _writing(shared, out: str, bits: int, block: int, end_id: int, file_ids: int, file_docs: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = _store(out)
        task = TaskContext.get()
        encoder = _encoder(shared.value)
        writer = name = None
        done: list[tuple] = []

        def finish():
            writer.close()
            done.append((task.partitionId(), len(done), name, len(writer.ends), writer.n_ids))

        for batch in _by_bytes(batches):
            ids, sizes = encoder.encode(batch.columns[1])
            at = 0
            for key, n in zip(batch.columns[0].to_pylist(), sizes.tolist(), strict=True):
                if writer is not None and (writer.n_ids + n + 1 > file_ids or len(writer.ends) >= file_docs):
                    finish()
                    writer = None
                if writer is None:
                    # each attempt of a task has files of its own; the manifest names those that count
                    name = f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
                    writer = Writer(store.open_output_stream(f"{root}/{name}"), bits, block)
                writer.add(key, np.append(ids[at : at + n], np.uint32(end_id)))
                at += n
        if writer is not None:
            finish()
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _MANIFEST.split(", ")])

    return run


def write(
    docs: DataFrame, path: str, source: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None, block: int = 1 << 16, file_ids: int = 1 << 26, file_docs: int = 1 << 20,
) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, under ``path`` (a
    folder that all machines reach), in ascending order of the key over all files.

    Rows are dealt by ranges of the key, so files follow one another; texts are encoded in
    the task that writes them, and travel once. Null texts are empty, null keys come first;
    rows of one key are ordered by their texts' hash, and equal rows, however many, are dealt
    over several files by where they were read. ``files`` is the number of ranges (default:
    the session's shuffle partitions); a range's file ends at ``file_ids`` ids or
    ``file_docs`` documents and another follows. A task holds one block of ids and the index
    of its file. A lost task writes new files; the manifest (Parquet, beside them) names
    those of the attempts that were committed.
    """
    spark = docs.sparkSession
    vocab = json.loads(source)
    n_ids = 1 + max(max(vocab["model"]["vocab"].values()), end_id, *(t["id"] for t in vocab.get("added_tokens") or [{"id": 0}]))
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ranges = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("key"), "h", "at"]
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("key", "text")
    shared = spark.sparkContext.broadcast(source)
    made = rows.mapInArrow(_writing(shared, path, width(n_ids), block, end_id, file_ids, file_docs), _MANIFEST)
    made.write.mode("error").parquet(f"{path.rstrip('/')}/manifest")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(uri, start, n_docs, n_ids) of every file that counts, in order; start is the number
    of ids in the files before. The driver holds one row of a file (of up to 2^26 ids)."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy("part", "piece").collect()
    starts = np.concatenate(([0], np.cumsum([r.n_ids for r in rows]))).tolist()
    made = [(f"{path.rstrip('/')}/{r.name}", start, r.n_docs, r.n_ids) for r, start in zip(rows, starts, strict=False)]
    out = spark.createDataFrame(made, "uri string, start long, n_docs long, n_ids long")
    return out.repartition(len(made)) if made else out


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, token_ids) of every document,
    read from the files; start is the number of ids of all documents before."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<long>" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        def batch_of(reader, start, some):
            at = [d for d, _ in some]
            ends = reader.ends[at]
            sizes = np.array([len(x) for _, x in some], np.int64)
            made = [
                pa.array(reader.keys[at], pa.int64(), mask=reader.null[at]), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in some], pa.int64()),
            ]
            if ids:
                flat = np.concatenate([x for _, x in some]).astype(np.int64)
                made.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat)))
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, at = _store(uri)
                with store.open_input_file(at) as file:
                    reader, some, n = Reader(file), [], 0
                    for d, x in reader.documents():
                        some.append((d, x))
                        n += len(x)
                        if n >= 1 << 18 or len(some) >= 4096:
                            yield batch_of(reader, start, some)
                            some, n = [], 0
                    if some:
                        yield batch_of(reader, start, some)

    return files_of(spark, path).mapInArrow(run, schema)


def read_slice(spark: SparkSession, path: str, lo: int, hi: int) -> np.ndarray:
    """The ids from place lo to before hi of the whole corpus, by the blocks that hold them:
    for a trainer's random access, so on the caller's own machine."""
    got = []
    for f in files_of(spark, path).where((F.col("start") < hi) & (F.col("start") + F.col("n_ids") > lo)).orderBy("start").collect():
        store, at = _store(f.uri)
        with store.open_input_file(at) as file:
            got.append(Reader(file).span(max(lo - f.start, 0), min(hi - f.start, f.n_ids)))
    return np.concatenate(got) if got else np.zeros(0, np.uint32)

