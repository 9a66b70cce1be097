"""Token ids of documents in binary files of shuffled planes, written and read by Spark tasks.

A file holds the ids of consecutive documents in blocks of BLOCK_IDS ids, the last shorter. A block is transposed:
all lowest bytes of its ids, then all second bytes and so on (or, on request, bit by bit), and each of these planes is
one Zstandard frame; a plane of zeros alone takes no bytes. After the blocks come the documents (id and number of
ids), the index of the blocks (place in the file, first id, ids, bytes of each plane), both as Arrow streams, and a
tail of fixed size that finds them. So any range of ids is read by the blocks that hold it alone.

Documents lie in ascending order of their ids over all files; a manifest holds the files in that order, from which
the first id of each file follows.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import as_array, drop_saved, give_back, new_path, saved, sent_if_small, slices
from .warc import _filesystem

END_ID = 2
#: Ids in a block, and ids after which a task starts its next file (with a document).
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 24
LEVEL = 3
MAGIC = b"IDPLANE1"
#: Places of documents, index and tail, ids, documents, whether planes are bits.
TAIL = struct.Struct("<QQQQQB")
#: Parts in each of the two generations of a task's cache of ids, the longest that is kept, bytes of text encoded at once.
CACHE_PARTS, CACHED_CHARS, SLICE_BYTES = 200_000, 48, 8 << 20
#: The first character after the Latin blocks, and a space in byte-level vocabularies.
LATIN_END, SPACE = "\u0250", "\u0120"
#: Rows of a manifest (one for each FILE_IDS ids) that are sent to all tasks at most.
SENT_ROWS = 100_000


def planes(ids: np.ndarray, bits: bool = False) -> list[np.ndarray]:
    """The four byte planes, or 32 bit planes, of ids, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(rows[:, k]) for k in range(32)]
    return [np.ascontiguousarray(rows[:, k]) for k in range(4)]


def joined(parts: list[np.ndarray | None], n: int, bits: bool = False) -> np.ndarray:
    """The n ids of planes; None is a plane of zeros."""
    rows = np.zeros((n, len(parts)), np.uint8)
    for k, part in enumerate(parts):
        if part is not None:
            rows[:, k] = np.unpackbits(part, count=n) if bits else part
    if bits:
        rows = np.packbits(rows, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class IdWriter:
    """Writes one file to a binary stream: add() takes the ids of whole documents, close() ends the file."""

    def __init__(self, out, kind: pa.DataType, bits: bool = False, level: int = LEVEL, block_ids: int = BLOCK_IDS):
        import zstandard as z

        self.out, self.kind, self.bits, self.block_ids = out, kind, bits, block_ids
        self.compressor = z.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.docs: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.index: list[tuple[int, int, int, list[int]]] = []
        self.ids = self.n_docs = self.held = 0
        self.at = out.write(MAGIC)

    def add(self, docs: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs), self.lengths.append(lengths), self.waiting.append(ids)
        self.n_docs += len(docs)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(self.held - self.held % self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for k in range(0, n, self.block_ids):
            block = ids[k : min(n, k + self.block_ids)]
            packed = [self.compressor.compress(p.tobytes()) if p.any() else b"" for p in planes(block, self.bits)]
            self.index.append((self.at, self.ids, len(block), [len(p) for p in packed]))
            self.at += self.out.write(b"".join(packed))
            self.ids += len(block)
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def _table(self, columns: dict[str, pa.Array | pa.ChunkedArray]) -> int:
        sink, table = pa.BufferOutputStream(), pa.table(columns)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        place = self.at
        self.at += self.out.write(sink.getvalue().to_pybytes())
        return place

    def close(self) -> None:
        self._flush(self.held)
        docs = self._table({"doc_id": pa.chunked_array(self.docs, self.kind), "n": pa.array(np.concatenate([np.empty(0, np.int64), *self.lengths]))})
        at, first, n, sizes = ([x[k] for x in self.index] for k in range(4))
        index = self._table({"at": pa.array(at, pa.int64()), "first": pa.array(first, pa.int64()), "n": pa.array(n, pa.int64()), "planes": pa.array(sizes, pa.list_(pa.int64()))})
        self.out.write(TAIL.pack(docs, index, self.at, self.ids, self.n_docs, self.bits) + MAGIC)


class IdReader:
    """Reads a file's bytes; only the blocks of the ids asked for are decompressed."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[: len(MAGIC)]) != MAGIC or bytes(self.data[-len(MAGIC) :]) != MAGIC:
            raise ValueError("not a file of token ids")
        docs, index, end, self.ids, self.n_docs, self.bits = TAIL.unpack(self.data[-len(MAGIC) - TAIL.size : -len(MAGIC)])
        self.docs = pa.ipc.open_stream(pa.py_buffer(self.data[docs:index])).read_all()
        blocks = pa.ipc.open_stream(pa.py_buffer(self.data[index:end])).read_all()
        self.at, self.first, self.n = (blocks.column(c).to_numpy() for c in ("at", "first", "n"))
        self.sizes = blocks.column("planes").to_pylist()

    def block(self, k: int) -> np.ndarray:
        import zstandard as z

        parts, at, reader = [], int(self.at[k]), z.ZstdDecompressor()
        for size in self.sizes[k]:
            parts.append(np.frombuffer(reader.decompress(self.data[at : at + size]), np.uint8) if size else None)
            at += size
        return joined(parts, int(self.n[k]), self.bits)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop (exclusive), numbered from 0 in this file."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.empty(0, "<u4")
        a, b = np.searchsorted(self.first, [start, stop - 1], "right") - 1
        ids = np.concatenate([self.block(k) for k in range(a, b + 1)])
        return ids[start - int(self.first[a]) : stop - int(self.first[a])]

    def each(self) -> Iterator[np.ndarray]:
        """The ids of each document; every block is decompressed once."""
        held, k = np.empty(0, "<u4"), 0
        for n in self.docs.column("n").to_pylist():
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.block(k))
                have, k = have + len(more[-1]), k + 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield held[:n]
            held = held[n:]


class PartEncoder:
    """Ids of texts by a public tokenizer, with a cache of the ids of parts.

    A byte-level tokenizer with its usual pattern never makes a token over the place between a character that is no
    white space and a white space after it, nor between an ASCII letter and punctuation after it; texts are cut there
    and each different part is encoded once while the cache holds it. With any other normaliser, pattern or special token whole texts are.
    """

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        cut = told["pre_tokenizer"] or {}
        plain = not told["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not told["truncation"] and not told["padding"]
        # Special tokens must not hold a place where texts are cut.
        self.cuts = bool(plain) and all(self._whole(t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in told["added_tokens"])
        self.merges = self.tokenizer.model
        # Byte-level vocabularies write a printable byte as itself and the others as characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.cache_parts = cache_parts

    @staticmethod
    def places(data: np.ndarray) -> np.ndarray:
        """Whether a part may begin at each byte."""
        space = (data == 32) | ((data >= 9) & (data <= 13))
        lower = data | 32
        letter = (lower >= 97) & (lower <= 122)
        # The bar stays with a letter before it, as special tokens end in bar and bracket.
        point = (data > 32) & (data < 127) & ~letter & ((data < 48) | (data > 57)) & (data != 124)
        back1, back2, back3 = (np.concatenate([np.full(k, 65, np.uint8), data[:-k]])[: len(data)] for k in (1, 2, 3))
        # A character beyond ASCII before may be a white space itself: not told apart, such places are no cuts.
        wide = (back1 >= 128) & (((back2 == 0xC2) & ((back1 == 0x85) | (back1 == 0xA0))) | ((back3 >= 0xE1) & (back3 <= 0xE3) & ((back2 == 0x80) | (back2 == 0x81) | (back2 == 0x9A))))
        before = np.concatenate([[True], space[:-1]])[: len(data)]
        after_letter = np.concatenate([[False], letter[:-1]])[: len(data)]
        return (space & ~before & ~wide) | (point & after_letter)

    def _whole(self, text: str) -> bool:
        return not self.places(np.frombuffer(text.encode(), np.uint8)).any()

    def _one(self, part: str) -> bytes:
        """A part that is one run of Latin letters, with a space before it or none, goes to the merges directly."""
        core = part[1:] if part[:1] == " " else part
        if not core.isalpha():
            return self._rest([part])[0]
        if core.isascii():
            spelled = part if core is part else SPACE + core
        elif max(core) < LATIN_END:
            spelled = part.encode().decode("latin-1").translate(self.letters)
        else:
            return self._rest([part])[0]
        return array("I", [t.id for t in self.merges.tokenize(spelled)]).tobytes()

    def _rest(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part; parts that were met since the cache's last but one turn need no encoding."""
        out, young, old = [], self.known, self.before
        for part in parts:
            got = young.get(part)
            if got is None:
                got = old.get(part) or (self._one(part) if self.cuts else self._rest([part])[0])
                if len(part) <= CACHED_CHARS:
                    young[part] = got
            out.append(got)
        if len(young) > self.cache_parts:
            self.known, self.before = {}, young
        return out

    def forget(self) -> None:
        """Empty the caches and give back unused memory: a worker goes on to tasks of other operators."""
        self.known, self.before = {}, {}
        give_back()

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, with its end id, and all ids."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        begins = self.places(data) if self.cuts else np.zeros(len(data), bool)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        begins = np.flatnonzero(begins)
        ends = np.append(begins, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        encoded = [*self._encoded(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), np.array([end_id], np.uint32).tobytes()]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.frombuffer(b"".join(encoded), np.uint32)
        # The end id is a part of its own after the last part of each text.
        last = np.searchsorted(begins, bounds[1:])
        codes = np.insert(parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), last, len(encoded) - 1)
        n = lengths[codes]
        total = np.cumsum(n)
        ids = pool[np.repeat(firsts[codes] - total + n, n) + np.arange(total[-1] if len(total) else 0)]
        stops = total[last + np.arange(len(last))]
        return np.diff(stops, prepend=0), ids


_encoders: dict[str, PartEncoder] = {}


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, bits: bool = False, level: int = LEVEL, file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of all documents to files in folder, a URI of shared storage: the manifest (name, part, file, docs, ids), computed when read.

    Documents go in ascending order of their ids, null first, equal ids in a fixed order of their texts; a hot id is
    dealt to several tasks by its texts and rows. Each text is whole, a null text is empty and has its end id alone;
    no document lies in two files; an empty table writes none. A task writes a file under a name of its attempt and
    renames it, so a retried task replaces its own files.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _encoders:
            _encoders[tokenizer] = PartEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        filesystem, root = _filesystem(folder)
        context, count = TaskContext.get(), 0
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        writer, out = None, None

        def close() -> pa.RecordBatch:
            nonlocal writer, out, count
            writer.close()
            out.close()
            name = f"part-{partition:06d}-{count:05d}.ids"
            filesystem.move(f"{root}/.{partition}-{count}-{attempt}.tmp", f"{root}/{name}")
            done = pa.RecordBatch.from_pydict({"name": [name], "part": [partition], "file": [count], "docs": [writer.n_docs], "ids": [writer.ids]})
            writer, count = None, count + 1
            return done

        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                if writer is None:
                    out = filesystem.open_output_stream(f"{root}/.{partition}-{count}-{attempt}.tmp")
                    writer = IdWriter(out, batch.column("i").type, bits, level, block_ids)
                writer.add(batch.column("i"), *encoder(as_array(batch.column("t")), end_id))
                if writer.ids + writer.held >= file_ids:
                    yield close()
        if writer is not None:
            yield close()
        encoder.forget()

    filesystem, root = _filesystem(folder)
    filesystem.create_dir(root, recursive=True)
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
    ordered = own.repartitionByRange("i", "h", "r").sortWithinPartitions("i", "h", "r").select("i", "t")
    assert kind in ("bigint", "int", "smallint", "tinyint", "string"), f"ids of type {kind}"
    return ordered.mapInArrow(run, "name string, part long, file long, docs long, ids long")


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """Every document of the files in folder: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (and ids if with_ids).

    The manifest's running sum is one task's: it has a row for each FILE_IDS ids.
    """
    kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for path, data in zip(whole.column("path").to_pylist(), whole.column("content"), strict=True):
                reader = IdReader(data.as_buffer())
                n = reader.docs.column("n").to_numpy()
                starts, each, done = np.cumsum(n) - n, reader.each(), 0
                for chunk in reader.docs.column("doc_id").chunks:
                    crc, ids = [], []
                    for _, one in zip(range(len(chunk)), each):
                        crc.append(zlib.crc32(one.tobytes()))
                        if with_ids:
                            ids.append(one.astype(np.int32))
                    to = done + len(chunk)
                    columns = [pa.array([path.rpartition("/")[2]] * len(chunk)), chunk.cast(kind), pa.array(starts[done:to]), pa.array(n[done:to]), pa.array(crc, pa.int64())]
                    names = ["name", "doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    done = to

    bases = manifest.select("name", (F.sum("ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))).alias("base")).fillna(0, ["base"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    rows = files.mapInArrow(run, f"name string, doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return rows.join(sent_if_small(bases, SENT_ROWS), "name").withColumn("start", F.col("start") + F.col("base")).drop("name", "base")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, bits: bool = False, with_ids: bool = False) -> DataFrame:
    """Write the ids of docs to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32 (and ids).

    Null and empty texts have their end id alone, repeated rows a row each, an empty table no rows.
    """
    spark, folder, kind = docs.sparkSession, new_path(docs.sparkSession, "ids"), docs.schema[id_col].dataType.simpleString()
    manifest = saved(write(docs, folder, tokenizer, id_col, text_col, end_id, bits), "manifest")
    if manifest.isEmpty():
        drop_saved(manifest)
        return spark.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return read(spark, folder, manifest, kind, with_ids)
