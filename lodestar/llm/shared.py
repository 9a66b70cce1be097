"""What the operators share: tables in the shared folder, vectorised word splitting, packed 64-bit hashes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: Where the tables made by saved() lie.
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder of its own; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own["dir"])
    return f"file://{_own['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors, computes once.

    Spark drops the shuffle files that the write needed as soon as it ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Remove the files of tables made by saved() that nothing reads any more."""
    for df in tables:
        _, path = _paths.pop(id(df))
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def filesystem(uri: str):
    """For tasks that read or write files of the shared folder: pyarrow's file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{os.path.abspath(uri)}")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: functions over batches look columns up by names, which may hold dots or repeat."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, counted, with the hint to send it to all tasks if it has at most so many (narrow) rows."""
    return F.broadcast(df) if df.count() <= rows else df


def give_back() -> None:
    """At a task's end: return what Python and Arrow have freed to the system, as an idle worker keeps it from other operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def byte_table(separators: bytes = b"", lower: bool = True) -> np.ndarray:
    """A map of bytes: A-Z to a-z if lower, separators to a space, all others as they are."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 32
    return table


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of 64-bit offset strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte mapped by table, which must keep UTF-8 valid (only ASCII bytes may change)."""
    _, offsets, data = texts.buffers()
    if data is None or not data.size:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)])], offset=texts.offset)


class Words:
    """The words of a batch of texts: row i has codes[starts[i]:starts[i + 1]], codes index vocabulary.

    Words are runs of anything but the six ASCII white-space characters.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        codes, vocabulary = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py() if len(vocabulary) else -1
        if empty >= 0:
            keep = codes != empty
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            codes = codes[keep]
        self.starts, self.codes, self.vocabulary = ends, codes, vocabulary

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def row(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i + 1]]


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string, the same in every process."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products of hashes spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive hashes of h; order counts."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    size, step, out = len(h) - n + 1, np.uint64(0x9E3779B97F4A7C15), np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mixed(out + h[i : i + size] + step)
    return out


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20):
    """The batch in runs of rows whose texts have max_bytes in all, a longer text alone: bounds memory, not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > max_bytes and i > begin:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


class Runs:
    """The words of a batch of texts, cut where a table of bytes says so, A-Z in lower case.

    kinds maps a byte to 0 (part of a word), 1 (between words) or 2 (between words, and ends a piece of text). Row i
    has codes[starts[i]:starts[i + 1]], codes index vocabulary; words of one piece have the same number in pieces().
    """

    def __init__(self, texts: pa.Array, kinds: np.ndarray):
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        self.kind = kinds[data]
        word = self.kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        filled = bounds[:-1][np.diff(bounds) > 0]
        first[filled] = word[filled]
        final = bounds[1:][np.diff(bounds) > 0] - 1
        last[final] = word[final]
        self.begins = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - self.begins
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        spelled = byte_table()[data[word]]
        words = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(spelled)]).dictionary_encode()
        self.codes, self.vocabulary = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        self.starts = np.searchsorted(self.begins, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def pieces(self) -> np.ndarray:
        """A number for each word that grows from one piece of text to the next."""
        return np.cumsum(self.kind == 2, dtype=np.int32)[self.begins] + self.rows()


def byte_kinds(*between: str, ends: str = "") -> np.ndarray:
    """A table for Runs: the ASCII characters of the strings of between separate words, those of ends pieces too."""
    kinds = np.zeros(256, np.uint8)
    kinds[np.frombuffer("".join(between).encode(), np.uint8)] = 1
    kinds[np.frombuffer(ends.encode(), np.uint8)] = 2
    return kinds
