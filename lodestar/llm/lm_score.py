"""Language-model scores from Elias-Fano n-gram tries, each a shard of the model.

Tasks turn documents into blocks of token numbers, written once. Each block asks the shards for what it needs:
its distinct words, then its distinct pairs with their distinct third words, go with their training counts to the
shard that a hash names. A shard sums the counts of all blocks, builds its trie, maps it and answers every
block's own keys. Rows that travel are packed arrays of distinct keys, so frequent words and copies cost a block
one key each. A block sends a shard one row, so rows grow with blocks times shards until a row holds one key, and
with the keys from there on.

A trie has three levels: nodes, their second words, the third words of those. Each is an Elias-Fano sequence; a
word counts from its parent's place in the level above, and monotone pointers, Elias-Fano too, bound the range in
which it is searched. A node is a context word and a slice of its successors by their hash, so that the successors
of a frequent word lie in several shards.

Smoothing is absolute discounting, interpolated. The levels hold 16-bit quantised log10 probabilities:
of a third word  a3 = (c(uvw) - D) / c(uv) and of its pair the back-off weight b3 = D * types(uv) / c(uv);
of a second word a2 = (c(vw) - D) / c(v, s) and of its node b2 = D * types(v, s) / c(v, s) and c(v, s) / N.
With P1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)) and Q(s) the sum of P1 over the slice s of w:
P2(w | v) = (c(v, s) + K * Q(s)) / (c(v) + K) * (a2 + b2 * P1(w) / Q(s)),  P3(w | u, v) = a3 + b3 * P2(w | v).
What was not seen in training has a = 0 and b = 1.
"""

from __future__ import annotations

import struct
import tempfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, as_array, byte_table, hashes, mixed, saved, slices, translated

#: What absolute discounting takes off every count (D), and the weight of a slice's own share (K).
DISCOUNT, SLICE_STRENGTH = 0.75, 16.0
#: Training documents are those whose crc32 is not HELD_OUT modulo FOLDS.
FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 12 << 20
#: Tokens to a shard, about.
SHARD_TOKENS = 2_000_000
#: Bits of a word's hash below its parent, and of the slices of a context.
WORD_BITS, SLICE_BITS = 28, 4
WORD_MASK = np.uint64((1 << WORD_BITS) - 1)
#: Steps of a factor of ten in a quantised probability.
STEPS = 4096
#: White space is in no word, so these stand for the end and the beginning of a text.
END, BEGIN = "\n", "\t"
TABLE = byte_table()


def squeezed(values: np.ndarray) -> bytes:
    """An array's byte planes, each a compressed block of its own: most counts, codes and token numbers are small or alike."""
    if not values.size:
        return b""
    planes = np.ascontiguousarray(values.ravel()).view(np.uint8).reshape(-1, values.itemsize).T
    stream = zstandard.ZstdCompressor(level=1).compressobj()
    return b"".join(part for plane in planes for part in (stream.compress(plane.tobytes()), stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))) + stream.flush()


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data) if len(data) else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps_of(keys: np.ndarray) -> np.ndarray:
    """The differences of sorted keys, which squeeze better."""
    return np.diff(keys, prepend=np.uint64(0))


def records(codes: np.ndarray) -> np.ndarray:
    """Pairs of 16-bit codes as 32-bit records."""
    return np.ascontiguousarray(codes).view("<u4").ravel()


class EliasFano:
    """A non-decreasing sequence of integers below 2^64, quasi-succinct, over any buffer."""

    def __init__(self, n: int, bits: int, high: np.ndarray, low: np.ndarray):
        self.n, self.bits, self.high, self.low = n, np.uint64(bits), high, low
        #: Ones up to and with each word of 64 high bits: two bits an entry.
        self.ranks = np.cumsum(np.bitwise_count(high), dtype=np.int64)

    @staticmethod
    def packed(values: np.ndarray) -> bytes:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        bits = max(bits, top.bit_length() - 30)
        unary = np.zeros((top >> bits) + n + 1, np.uint8)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").tobytes()
        high += bytes(-len(high) % 8)
        spread = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(spread.ravel(), bitorder="little").tobytes()
        low += bytes(16 + -len(low) % 8)
        return struct.pack("<QQQQ", n, bits, len(high), len(low)) + high + low

    @classmethod
    def opened(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence at this byte of data, and where the next one begins."""
        n, bits, high, low = struct.unpack("<QQQQ", data[at : at + 32].tobytes())
        begin = at + 32 + high
        return cls(n, bits, data[at + 32 : begin].view(np.uint64), data[begin : begin + low].view(np.uint64)), begin + low

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.bits
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (self.low[word] >> shift | upper) & ((np.uint64(1) << self.bits) - np.uint64(1))

    def _select(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th one among the high bits."""
        word = np.searchsorted(self.ranks, i, "right")
        rest, at = self.high[word], word << 6
        left = i - self.ranks[word] + np.bitwise_count(rest)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(rest & np.uint64((1 << width) - 1))
            beyond = left >= ones
            left = left - np.where(beyond, ones, 0)
            at = at + width * beyond
            rest = np.where(beyond, rest >> np.uint64(width), rest)
        return at

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i) - i).astype(np.uint64) << self.bits | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The index of each value in its range from begin to end, or -1: a successor search in every range."""
        low, high = begin.copy(), end.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less = self[middle] < values[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        found = low < end
        found[found] = self[low[found]] == values[found]
        return np.where(found, low, -1)


def quantised(p: np.ndarray) -> np.ndarray:
    """1 + the quantised -log10 of probabilities; 0 for 0."""
    steps = np.round(-np.log10(np.where(p > 0, p, 1.0)) * STEPS) + 1
    return np.where(p > 0, np.clip(steps, 1, 65535), 0).astype("<u2")


def restored(codes: np.ndarray, absent: float) -> np.ndarray:
    """The probabilities of codes, and absent for 0."""
    return np.where(codes > 0, 10 ** ((1 - codes.astype(np.float64)) / STEPS), absent)


def _pointers(parents: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=n))]).astype(np.uint64)


def trie(pairs: np.ndarray, counts: np.ndarray, parents: np.ndarray, thirds: np.ndarray, third_counts: np.ndarray, tokens: int) -> bytes:
    """The packed trie of sorted distinct pair keys and the sorted distinct (index of pair, third word) below them."""
    nodes, node = np.unique(pairs >> np.uint64(WORD_BITS), return_inverse=True)
    of_node, of_pair = np.bincount(node, counts, len(nodes)), np.bincount(parents, third_counts, len(pairs))
    levels = [
        nodes, _pointers(node, len(nodes)), node.astype(np.uint64) << np.uint64(WORD_BITS) | pairs & WORD_MASK,
        _pointers(parents, len(pairs)), parents.astype(np.uint64) << np.uint64(WORD_BITS) | thirds,
    ]
    back_off = np.stack([quantised(DISCOUNT * np.bincount(node, minlength=len(nodes)) / of_node), quantised(of_node / max(tokens, 1))], 1)
    types = np.bincount(parents, minlength=len(pairs))
    second = np.stack([quantised((counts - DISCOUNT) / of_node[node]), quantised(DISCOUNT * types / np.maximum(of_pair, 1))], 1)
    third = quantised((third_counts - DISCOUNT) / of_pair[parents])
    return b"".join(EliasFano.packed(level) for level in levels) + back_off.tobytes() + second.tobytes() + third.tobytes()


class Trie:
    """A packed trie in a memory-mapped file of the task that built it."""

    def __init__(self, packed: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(packed)
        self.file.flush()
        data, at = np.memmap(self.file, np.uint8, "r"), 0
        self.nodes, at = EliasFano.opened(data, at)
        self.pair_pointers, at = EliasFano.opened(data, at)
        self.pairs, at = EliasFano.opened(data, at)
        self.third_pointers, at = EliasFano.opened(data, at)
        self.thirds, at = EliasFano.opened(data, at)
        self.node_codes = data[at : (at := at + 4 * self.nodes.n)].view("<u2").reshape(-1, 2)
        self.pair_codes = data[at : (at := at + 4 * self.pairs.n)].view("<u2").reshape(-1, 2)
        self.third_codes = data[at : at + 2 * self.thirds.n].view("<u2")

    def __enter__(self) -> Trie:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def find_nodes(self, nodes: np.ndarray) -> np.ndarray:
        return self.nodes.find(nodes, np.zeros(len(nodes), np.int64), np.full(len(nodes), self.nodes.n))

    def find_below(self, parents: np.ndarray, words: np.ndarray, pointers: EliasFano, level: EliasFano) -> np.ndarray:
        """Where words lie in the level below their parents, within the parents' ranges; -1 if not there."""
        at = np.full(len(parents), -1)
        known = np.flatnonzero(parents >= 0)
        parent = parents[known]
        values = parent.astype(np.uint64) << np.uint64(WORD_BITS) | words[known]
        at[known] = level.find(values, pointers[parent].astype(np.int64), pointers[parent + 1].astype(np.int64))
        return at

    def codes(self, pairs: np.ndarray, parents: np.ndarray, thirds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of the distinct nodes of sorted pair keys, of the pairs, and of (index of pair, third word); 0 for what is not there."""
        nodes, node = np.unique(pairs >> np.uint64(WORD_BITS), return_inverse=True)
        node_at = self.find_nodes(nodes)
        pair_at = self.find_below(node_at[node], pairs & WORD_MASK, self.pair_pointers, self.pairs)
        third_at = self.find_below(pair_at[parents], thirds, self.third_pointers, self.thirds)
        return tuple(_taken(codes, at) for codes, at in ((self.node_codes, node_at), (self.pair_codes, pair_at), (self.third_codes, third_at)))


def _taken(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), *codes.shape[1:]), "<u2")
    out[at >= 0] = codes[at[at >= 0]]
    return out


def slice_of(words: np.ndarray) -> np.ndarray:
    """The slice of each word hash: its top bits, which also name the word's shard."""
    return words >> np.uint64(64 - SLICE_BITS)


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of each pair of word hashes: a node's hash above, the second word's below."""
    node = mixed(context * np.uint64(0x9E3779B97F4A7C15) + slice_of(word))
    return node & ~WORD_MASK | mixed(word) & WORD_MASK


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as blocks: block, ids, training, sizes (tokens, the end counted), vocabulary (steps of sorted hashes), tokens (32-bit indices into it), both squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        end = hashes(pa.array([END]))
        for whole in batches:
            for batch in slices(whole, "t", BLOCK_BYTES):
                words = Words(translated(as_array(batch.column("t")), TABLE))
                hashed = np.concatenate([hashes(words.vocabulary), end])
                order = np.argsort(hashed, kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                tokens = place[np.insert(words.codes.astype(np.int64), words.starts[1:], len(hashed) - 1)]
                ids = batch.column("i")
                training = [zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS != HELD_OUT for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([training], pa.list_(pa.bool_())), pa.array([words.counts + 1], pa.list_(pa.int64())), pa.array([squeezed(steps_of(hashed[order]))], pa.binary()), pa.array([squeezed(tokens)], pa.binary())],
                    names=["block", "ids", "training", "sizes", "vocabulary", "tokens"],
                )
                number += 1

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"block long, ids array<{kind}>, training array<boolean>, sizes array<long>, vocabulary binary, tokens binary")


class Grams(NamedTuple):
    """A block's words, and its distinct pairs and distinct (pair, third word)."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    training: np.ndarray  # of each token
    pairs: np.ndarray  # sorted keys
    pair: np.ndarray  # of each token and the one before it, an index of pairs
    inner: np.ndarray  # tokens that are not the first of their text
    triples: np.ndarray  # sorted, index of the pair before << WORD_BITS | third word
    triple: np.ndarray  # of each inner token, an index of triples


def _words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's row: vocabulary, tokens, sizes, each token's training mark."""
    sizes = np.asarray(row["sizes"], np.int64)
    return np.cumsum(unsqueezed(row["vocabulary"], "<u8")), unsqueezed(row["tokens"], "<i4"), sizes, np.repeat(np.asarray(row["training"], bool), sizes)


def _grams(row: dict) -> Grams:
    vocabulary, tokens, sizes, training = _words(row)
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(sizes) - sizes] = True
    words = vocabulary[tokens]
    before = np.roll(words, 1)
    before[first] = hashes(pa.array([BEGIN]))[0]
    pairs, pair = np.unique(pair_keys(before, words), return_inverse=True)
    inner = np.flatnonzero(~first)
    below = pair[inner - 1].astype(np.uint64) << np.uint64(WORD_BITS) | mixed(vocabulary)[tokens[inner]] & WORD_MASK
    triples, triple = np.unique(below, return_inverse=True)
    return Grams(vocabulary, tokens, sizes, training, pairs, pair, inner, triples, triple)


def _shard_spans(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the runs of sorted keys with the same top bits."""
    if not len(keys):
        return []
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    return list(zip(shard[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _asked_words(table: DataFrame, bits: int) -> DataFrame:
    """What each block asks of each shard of words: its sorted distinct hashes there and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, tokens, _, training = _words(row)
                counts = np.bincount(tokens[training], minlength=len(keys)).astype("<u4")
                spans = _shard_spans(keys, bits)
                out = [(shard, row["block"], squeezed(steps_of(keys[a:b])), squeezed(counts[a:b])) for shard, a, b in spans]
                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "block", "keys", "counts"), r, strict=True)) for r in out], schema=_schema(("keys", "counts")))

    return table.mapInArrow(run, "shard long, block long, keys binary, counts binary")


def _asked_grams(table: DataFrame, bits: int) -> DataFrame:
    """What each block asks of each trie: its distinct pairs there, the third words below each, and the training counts of both."""
    names = ("keys", "counts", "fans", "thirds", "third_counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = _grams(row)
                counts = np.bincount(g.pair[g.training], minlength=len(g.pairs)).astype("<u4")
                third_counts = np.bincount(g.triple[g.training[g.inner]], minlength=len(g.triples)).astype("<u4")
                ends = _pointers((g.triples >> np.uint64(WORD_BITS)).astype(np.int64), len(g.pairs)).astype(np.int64)
                fans, thirds = np.diff(ends).astype("<u4"), (g.triples & WORD_MASK).astype("<u4")
                for shard, a, b in _shard_spans(g.pairs, bits):
                    parts = (steps_of(g.pairs[a:b]), counts[a:b], fans[a:b], thirds[ends[a] : ends[b]], third_counts[ends[a] : ends[b]])
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([row["block"]], pa.int64()), *(pa.array([squeezed(x)], pa.binary()) for x in parts)], names=["shard", "block", *names])

    return table.mapInArrow(run, "shard long, block long, " + ", ".join(f"{n} binary" for n in names))


def _schema(binaries: tuple[str, ...], *longs: str) -> pa.Schema:
    return pa.schema([("shard", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in binaries), *((n, pa.int64()) for n in longs)])


def _joined(column: pa.ChunkedArray, kind: str, steps: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The squeezed arrays of a column's rows, one after the other, and where each but the first begins; null is empty."""
    arrays = [unsqueezed(v.as_buffer() if v.is_valid else b"", kind) for v in column]
    if steps:
        arrays = [np.cumsum(x) for x in arrays]
    return np.concatenate(arrays), np.cumsum([len(x) for x in arrays])[:-1]


def _parts(values: np.ndarray, begins: np.ndarray) -> list[bytes]:
    return [squeezed(part) for part in np.split(values, begins)]


#: The block of a row with a word shard's own types and total.
TOTALS = -1


def _answered_words(asked: DataFrame) -> DataFrame:
    """Every word shard's training counts for the blocks, and its types and total under the block TOTALS."""

    def run(table: pa.Table) -> pa.Table:
        keys, begins = _joined(table["keys"], "<u8", steps=True)
        every, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, _joined(table["counts"], "<u4")[0], len(every)).astype("<i8")
        answers = _parts(total[at], begins)
        n = len(answers)
        return pa.table([pa.array([table["shard"][0].as_py()] * (n + 1)), pa.array([*table["block"].to_pylist(), TOTALS]), pa.array([*answers, b""], pa.binary()), pa.array([0] * n + [int((total > 0).sum())]), pa.array([0] * n + [int(total.sum())])], schema=_schema(("counts",), "types", "total"))

    return asked.groupBy("shard").applyInArrow(run, "shard long, block long, counts binary, types long, total long")


def _answered_grams(asked: DataFrame, tokens: int) -> DataFrame:
    """Every trie's codes for the blocks: of their nodes, pairs and third words there, in the blocks' order."""

    def run(table: pa.Table) -> pa.Table:
        keys, begins = _joined(table["keys"], "<u8", steps=True)
        every, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, _joined(table["counts"], "<u4")[0], len(every))
        words, third_begins = _joined(table["thirds"], "<u4")
        below = np.repeat(at, _joined(table["fans"], "<u4")[0]).astype(np.uint64) << np.uint64(WORD_BITS) | words
        triples, triple = np.unique(below, return_inverse=True)
        third_total = np.bincount(triple, _joined(table["third_counts"], "<u4")[0], len(triples))
        parents, thirds = (triples >> np.uint64(WORD_BITS)).astype(np.int64), triples & WORD_MASK
        seen, third_seen = total > 0, third_total > 0
        place = np.cumsum(seen) - 1
        packed = trie(every[seen], total[seen], place[parents[third_seen]], thirds[third_seen], third_total[third_seen], tokens)
        with Trie(packed) as opened:
            node_codes, pair_codes, third_codes = opened.codes(every, parents, thirds)
        nodes = np.unique(every >> np.uint64(WORD_BITS))
        node_records = records(node_codes)
        own = [squeezed(node_records[np.searchsorted(nodes, np.unique(k >> np.uint64(WORD_BITS)))]) for k in np.split(keys, begins)]
        answers = (own, _parts(records(pair_codes)[at], begins), _parts(third_codes[triple], third_begins))
        return pa.table([table["shard"].combine_chunks(), table["block"].combine_chunks(), *(pa.array(a, pa.binary()) for a in answers)], schema=_schema(("nodes", "pairs", "thirds")))

    return asked.groupBy("shard").applyInArrow(run, "shard long, block long, nodes binary, pairs binary, thirds binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(id as text) modulo 5 is not 1 and scores all. Null and empty texts
    are one end token; a null id counts as an empty one; repeated rows count and are scored each; an empty table
    gives no rows; other columns are not read. Words are told apart by 64-bit hashes, pairs by 64 and third words
    below a pair by 28 bits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    table = saved(blocks(docs, id_col, text_col), "blocks")
    size = table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    bits = max(SLICE_BITS, (size // SHARD_TOKENS).bit_length())
    words = saved(_answered_words(_asked_words(table, bits)), "words")
    of_slice = F.shiftright("shard", bits - SLICE_BITS).cast("int")
    # One row for each of the 16 slices.
    known = words.where(F.col("block") == TOTALS).groupBy(of_slice.alias("s")).agg(F.sum("types").alias("v"), F.sum("total").alias("n")).collect()
    n, v = sum(int(r.n) for r in known), sum(int(r.v) for r in known)
    share = np.full(1 << SLICE_BITS, 0.5 / (1 << SLICE_BITS))
    for r in known:
        share[r.s] += r.n + 0.5 * r.v
    share /= n + 0.5 * (v + 1)
    grams = saved(_answered_grams(_asked_grams(table, bits), n), "grams")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        counts, thirds = _joined(right["counts"], "<i8")[0], _joined(right["thirds"], "<u2")[0]
        nodes, pairs = (_joined(right[c], "<u4")[0].view("<u2").reshape(-1, 2) for c in ("nodes", "pairs"))
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for row in left.to_pylist():
            g = _grams(row)
            one = (counts + 0.5) / (n + 0.5 * (v + 1))
            starts = np.cumsum(g.sizes) - g.sizes
            before = counts[np.roll(g.tokens, 1)]
            before[starts] = counts[np.searchsorted(g.vocabulary, hashes(pa.array([END]))[0])]  # texts begin as often as they end
            node = np.unique(g.pairs >> np.uint64(WORD_BITS), return_inverse=True)[1][g.pair]
            slices_ = share[slice_of(g.vocabulary).astype(np.int64)][g.tokens]
            of_slice = (restored(nodes[:, 1], 0.0)[node] * n + SLICE_STRENGTH * slices_) / (before + SLICE_STRENGTH)
            p = of_slice * (restored(pairs[:, 0], 0.0)[g.pair] + restored(nodes[:, 0], 1.0)[node] * one[g.tokens] / slices_)
            p[g.inner] = restored(thirds, 0.0)[g.triple] + restored(pairs[:, 1], 1.0)[g.pair[g.inner - 1]] * p[g.inner]
            out["doc_id"] += row["ids"]
            out["held_out"] += [not t for t in row["training"]]
            out["n_tokens"] += g.sizes.tolist()
            out["n_known"] += np.add.reduceat((counts[g.tokens] > 0).astype(np.int64), starts).tolist()
            out["train_tokens"] += [n] * len(g.sizes)
            out["base_score"] += np.add.reduceat(np.log10(one)[g.tokens], starts).tolist()
            out["score"] += np.add.reduceat(np.log10(p), starts).tolist()
        return pa.table(out, schema=pa.schema([("doc_id", left.schema.field("ids").type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    told = words.where(F.col("block") != TOTALS).drop("types", "total").unionByName(grams, allowMissingColumns=True)
    return table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
