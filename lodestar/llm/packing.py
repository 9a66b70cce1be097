"""Best-fit packing of tokenised documents into fixed-length training sequences.

Tasks tokenise and measure; only a histogram of piece lengths (at most `capacity` rows, whatever the input)
reaches the driver. The plan made from it is run-length coded: pieces above a third of the capacity are
matched greedily, at most two to a sequence; smaller ones best-fit the remaining gaps. Each piece then finds
its place by its length and its rank among equal lengths, which salted windows count.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_array, give_back, saved, slices

CAPACITY, END_ID = 4096, 1
#: Words in a task's cache of token ids (a generation begins at half as many), and the longest that is kept.
CACHE_WORDS, CACHED_CHARS = 300_000, 64
#: Bytes of text tokenised at once.
SLICE_BYTES = 2 << 20
#: Pieces of one length that one window ranks, about.
RANKED_TOGETHER = 1_000_000


class WordEncoder:
    """Token ids of white-space separated words, or parts of words, by a public tokenizer that drops white space.

    Words of ASCII and Latin-1 letters are cut as the tokenizer's pattern cuts them and go to its merges
    directly; any other word goes through the whole tokenizer. What was met last is kept in two generations.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[!-~À-ÿ]+").fullmatch
        # Byte-level vocabularies write a printable byte as itself and the others as characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return struct.pack(f"={len(ids)}I", *ids) if (ids := [t.id for t in self.merges.tokenize(spelled)]) else b""

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        if self.plain(word) and "<|" not in word:
            return b"".join(map(self._part, self.cut(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def __call__(self, vocabulary: list[str]) -> list[bytes]:
        if len(self.words) > self.cache_words // 2:
            self.words, self.older = {}, self.words
        known, older, out = self.words, self.older, []
        for word in vocabulary:
            got = known.get(word)
            if got is None:
                got = older.get(word)
                if got is None:
                    got = self._word(word)
                if len(word) <= CACHED_CHARS:
                    known[word] = got
            out.append(got)
        return out

    def forget(self) -> None:
        """Empty the caches and give back unused memory: a worker goes on to tasks of other operators."""
        self.words, self.older = {}, {}
        give_back()


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _kinds() -> np.ndarray:
    """What a byte is to the tokenizer's pattern: 0 space, 1 letter, 2 digit, 3 other, 4 in words that stay whole."""
    kinds = np.full(256, 4, np.uint8)
    kinds[33:127] = 3
    kinds[np.frombuffer(b" \t\n\v\f\r", np.uint8)] = 0
    kinds[48:58] = 2
    kinds[65:91] = kinds[97:123] = 1
    kinds[np.frombuffer(b"'<", np.uint8)] = 4
    # Of what is not ASCII, the Latin-1 letters alone: byte C3, then 80 to BF; two of these are signs.
    kinds[0x80:0xC0] = kinds[0xC3] = 1
    kinds[[0x97, 0xB7]] = 4
    return kinds


_KINDS = _kinds()


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The parts that texts' words can be encoded by: text i has codes[starts[i]:starts[i + 1]], codes index the vocabulary.

    Words are cut between letters, digits and other signs and around each digit, as the tokenizer's pattern does, and
    A-Z are in lower case; words with an apostrophe, which the pattern looks at, a `<`, which may begin a special
    token, or characters beyond Latin-1 letters stay whole and as they are.
    """
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    kind = _KINDS[data]
    # A byte from 80 to BF is a letter after C3 alone, and C3 only before such a byte, which valid UTF-8 has there.
    high = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    kind[high[data[high - 1] != 0xC3]] = 4
    filled = np.diff(bounds) > 0
    text_begins = bounds[:-1][filled]
    inside = kind != 0
    word_begins = inside.copy()
    word_begins[1:] &= ~inside[:-1]
    word_begins[text_begins] = inside[text_begins]
    number = np.cumsum(word_begins, dtype=np.int32) - 1
    whole = np.zeros(int(word_begins.sum()) + 1, bool)
    odd = np.flatnonzero(kind == 4)
    whole[number[odd]] = True
    keep = whole[number] & inside
    begins = word_begins.copy()
    begins[1:] |= inside[1:] & ~keep[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    first = np.flatnonzero(begins)
    lengths = np.add.reduceat(inside, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    spelled = data.copy()
    spelled[(data >= 65) & (data <= 90) & ~keep] += 32
    listed = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(spelled[inside])]).dictionary_encode()
    return np.searchsorted(first, bounds), listed.indices.to_numpy(zero_copy_only=False), listed.dictionary


def token_ids(texts: pa.Array, encoder: WordEncoder) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text."""
    starts, codes, vocabulary = parts(texts)
    encoded = encoder(vocabulary.to_pylist())
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    firsts = np.cumsum(lengths) - lengths
    pool = np.frombuffer(b"".join(encoded), np.uint32)
    n = lengths[codes]
    ends = np.cumsum(n)
    ids = pool[np.repeat(firsts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], ends])[starts]
    for i in range(len(texts)):
        yield ids[bounds[i] : bounds[i + 1]]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most capacity tokens: id, piece, start, length, ids_crc32 (and ids if keep_ids).

    A null or empty text is the end id alone. Rows with equal ids stay separate. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], np.uint32)
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(token_ids(as_array(batch.column("t")), encoder)):
                    ids = np.concatenate([ids, end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        row.append(i), piece.append(k), start.append(at), length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                columns = [batch.column("i").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.forget()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[length] pieces of each length, as runs (length, rank from, rank to, sequence, each, offset).

    The k-th piece of a run goes to sequence + k // each, at offset + k % each * length. A step either ends a
    length or uses up a run of equal gaps, so the plan's size follows the number of lengths, not of pieces.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    given: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gaps that have runs, ascending
    top = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, given[length], given[length] + n, sequence, each, offset))
        given[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - s) - 1
        while at >= 0 and (not left[large[at]] or large[at] == s and left[s] < 2):
            at -= 1
        t = large[at] if at >= 0 else 0
        n = (left[s] // 2 if t == s else min(left[s], left[t])) if t else left[s]
        put(s, n, top, 1, 0)
        if t:
            put(t, n, top, 1, s)
        leave(capacity - s - t, top, n)
        top += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap = capacity
                first, n = top, -(-left[s] // (gap // s))
                top += n
            each = gap // s
            used = min(n, left[s] // each)
            if used:
                put(s, used * each, first, each, capacity - gap)
                leave(gap - each * s, first, used)
            elif left[s]:
                each, used = left[s], 1
                put(s, each, first, each, capacity - gap)
                leave(gap - each * s, first, 1)
            leave(gap, first + used, n - used)
    return runs


def place(measured: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """measured (rows with length) plus sequence_id and offset."""
    counts = {r.length: r.n for r in measured.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    length, begin, _, sequence, each, offset = table.T
    salts = max(8, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(own)).join(before, ["length", "salt"])
    ranked = ranked.withColumn("place", F.col("place") - 1 + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "place"))
            # Ranks stay below 2^50 and lengths below 2^13, so one sorted key finds the run.
            at = np.searchsorted((length << 50) + begin, (own << 50) + rank, "right") - 1
            k = rank - begin[at]
            columns = [*(batch.column(c) for c in names), pa.array(sequence[at] + k // each[at]), pa.array(offset[at] + k % each[at] * own)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = measured.columns
    assert capacity < 1 << 13
    return ranked.select(*names, "place").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null and empty texts give one piece of one token; repeated rows give a piece each; an empty table gives
    no rows. Documents up to the capacity are never cut.
    """
    return place(saved(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces"), capacity)
