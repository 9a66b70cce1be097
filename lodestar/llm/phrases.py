"""Phrases of two to four words whose words keep together, per language, by merged count tries.

Three scans of the whole texts grow the trie of all phrases level by level. The first counts words. The second
makes, for each shard of text, a count trie of depth two over words that occur often enough, and the third one of
depth four over phrases all of whose pairs do: no other phrase can be a candidate, as a phrase occurs at most as often
as any part of it. What occurs often enough is told by Bloom filters of at most FILTER_BITS bits, whose false
positives cost room and never change a count.

A shard's trie is serialised in the sorted order of its paths and cut into ranges of prefixes: ranges of first words,
of second words below a first word that is hot, of third words below a hot pair. Each range's sorted runs of all shards
are merged in one task, k ways, and nodes that stay under the least count go. A walk over the merged trie in order
gives each phrase the counts of its left parts, which are its ancestors; suffix links, joins of each node with the node
of its path without the first word, give the counts of its right parts.

Words are 63-bit hashes of language and spelling; two words of one hash end the job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Runs, as_array, byte_kinds, hashes, mixed, saved, sent_if_small, slices

#: Least count of a candidate, words in the longest, phrases reported for a language.
LEAST_COUNT, LONGEST, TOP = 30, 4, 2000
#: A score is floor(SCALE a / (l + r)); a phrase goes if a longer one has COVERED percent of its count.
SCALE, COVERED = 2_000_000, 80
#: Bytes of text in a shard, and words of text behind one range of prefixes.
SHARD_BYTES, RANGE_WORDS = 8 << 20, 2_000_000
#: Bits of a filter at most, bits for each key below that, bits in a chunk of it that one task packs.
FILTER_BITS, KEY_BITS, CHUNK_BITS = 1 << 28, 16, 1 << 16
#: A word or pair with more than this share of all words is hot, so there are fewer hot ones than its inverse.
HOT_SHARE = 1 / 16384
#: Narrow rows that are sent to all tasks at most.
SENT_ROWS = 100_000
KINDS = byte_kinds(" \t", ends=".,;:!?\n\v\f\r")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PATH = ["h1", "h2", "h3", "h4"]


def path_key(columns: list[np.ndarray]) -> np.ndarray:
    """A key of each path for the filters; equal keys of different paths are false positives there."""
    key = columns[0].astype(np.uint64)
    for column in columns[1:]:
        key = mixed(key * _STEP + column.astype(np.uint64))
    return key


class Shard:
    """The words of a batch of texts, by language: words i and i + 1 are neighbours if pieces are equal."""

    def __init__(self, batch: pa.RecordBatch):
        runs = Runs(as_array(batch.column("t")), KINDS)
        lang = batch.column("l").dictionary_encode()
        self.langs = lang.dictionary
        of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[runs.rows()]
        found, self.codes = np.unique(of * max(1, len(runs.vocabulary)) + runs.codes, return_inverse=True)
        self.lang_of, self.word_of = np.divmod(found, max(1, len(runs.vocabulary)))
        self.vocabulary, self.runs = runs.vocabulary, runs
        spelled, named = hashes(runs.vocabulary), hashes(self.langs)
        both = mixed(spelled[self.word_of] + mixed(named)[self.lang_of]) if len(found) else np.empty(0, np.uint64)
        self.hashes = np.maximum(both >> np.uint64(1), np.uint64(1)).astype(np.int64)

    def ranked(self, known: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words that may be frequent, ascending, and each word's place there or -1."""
        kept = np.flatnonzero(known.may_hold(self.hashes.astype(np.uint64)))
        kept = kept[np.argsort(self.hashes[kept])]
        rank = np.full(len(self.hashes), -1, np.int64)
        rank[kept] = np.arange(len(kept))
        return self.hashes[kept], rank[self.codes]


class Filter:
    """A Bloom filter of two bits a key."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for part in (keys & self.mask, keys >> np.uint64(32) & self.mask):
            out &= self.bits[part >> np.uint64(3)] >> (part & np.uint64(7)).astype(np.uint8) & 1 > 0
        return out

    @staticmethod
    def of(keys: DataFrame) -> Filter:
        """The filter of a column of keys; tasks pack its chunks, and its bits are bounded by FILTER_BITS."""
        name = keys.columns[0]
        bits = min(FILTER_BITS, max(CHUNK_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
        places = keys.select(F.explode(F.array(F.col(name).bitwiseAND(bits - 1), F.shiftrightunsigned(name, 32).bitwiseAND(bits - 1))).alias("p"))
        chunks = places.groupBy(F.floor(F.col("p") / CHUNK_BITS).cast("int").alias("chunk")).agg(F.collect_set((F.col("p") % CHUNK_BITS).cast("int")).alias("bits"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = []
                for places in batch.column("bits"):
                    chunk = np.zeros(CHUNK_BITS, np.uint8)
                    chunk[places.values.to_numpy()] = 1
                    packed.append(np.packbits(chunk, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(packed, pa.binary())], names=["chunk", "bits"])

        out = np.zeros(bits // 8, np.uint8)
        for row in chunks.mapInArrow(run, "chunk int, bits binary").toLocalIterator():
            at = row.chunk * (CHUNK_BITS // 8)
            out[at : at + CHUNK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
        return Filter(out)


class Ranges:
    """Which range of prefixes a path belongs to, by its first word, or the second or third below hot prefixes."""

    def __init__(self, bits: int, hot_words: np.ndarray, hot_pairs: np.ndarray):
        self.shift, self.words, self.pairs = np.int64(63 - bits), np.sort(hot_words), np.sort(hot_pairs)

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        by = np.where(np.isin(columns[0], self.words), columns[1], columns[0])
        if len(columns) > 2:
            by = np.where(np.isin(path_key(columns[:2]).view(np.int64), self.pairs), columns[2], by)
        return by >> self.shift


def serialised(columns: list[np.ndarray], count: np.ndarray, parent: np.ndarray | None = None, below: np.ndarray | None = None, below_count: np.ndarray | None = None) -> bytes:
    """The trie of sorted paths (a column of words for each depth), with the nodes below them if given.

    Nodes go in the order of a walk: depths, then words, then counts, which inner nodes before the paths' depth lack.
    """
    deep, order = len(columns), np.arange(len(count)) * (len(columns) + 1)
    new = np.zeros(len(count), bool)
    nodes = []
    for d, column in enumerate(columns):
        new |= np.concatenate([[True], column[1:] != column[:-1]]) if len(column) else new
        at = np.flatnonzero(new) if d < deep - 1 else np.arange(len(count))
        nodes.append((order[at] + d, np.full(len(at), d + 1, np.uint8), column[at], count if d == deep - 1 else np.zeros(len(at), np.int64)))
    if below is not None:
        nodes.append((order[parent] + deep, np.full(len(below), deep + 1, np.uint8), below, below_count))
    place, depth, word, n = (np.concatenate(x) for x in zip(*nodes, strict=True))
    walk = np.argsort(place, kind="stable")
    n = n[walk]
    n = n.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if t == "<u8" or not len(n) or n.max() < 1 << 8 * int(t[2])))
    return bytes([n.itemsize]) + depth[walk].tobytes() + word[walk].astype("<i8").tobytes() + n.tobytes()


def paths(data: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The paths of one depth in a serialised trie, and their counts."""
    width = data[0]
    nodes = (len(data) - 1) // (9 + width)
    at = np.frombuffer(data, np.uint8, nodes, 1)
    word = np.frombuffer(data, "<i8", nodes, 1 + nodes)
    count = np.frombuffer(data, f"<u{width}", nodes, 1 + 9 * nodes)
    found, place = np.flatnonzero(at == depth), np.arange(nodes)
    columns = [word[np.maximum.accumulate(np.where(at == d, place, 0))[found]] for d in range(1, depth)]
    return [*columns, word[found]], count[found].astype(np.int64)


def merged(runs: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The paths of sorted runs in order, each once, with the sum of its counts.

    Words become ranks and paths one number each, in the same order; so every run is ascending, and a stable sort of
    all runs one after the other merges them.
    """
    columns = [np.concatenate(x) for x in zip(*(r[0] for r in runs), strict=True)]
    count = np.concatenate([r[1] for r in runs])
    if not len(count):
        return columns, count
    words = np.unique(np.concatenate(columns))
    number, most = np.searchsorted(words, columns[0]), len(words)
    for column in columns[1:]:
        if most * len(words) >= 1 << 62:
            known, number = np.unique(number, return_inverse=True)
            most = len(known)
        number = number * len(words) + np.searchsorted(words, column)
        most *= len(words)
    order = np.argsort(number, kind="stable")
    number = number[order]
    at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return [c[order[at]] for c in columns], np.add.reduceat(count[order], at)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l"))


def word_counts(docs: DataFrame, text_col: str, lang_col: str, least: int) -> DataFrame:
    """(h, lang, word, n) of the words with the least count, and rows without a word whose n add up to all of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, "t", SHARD_BYTES):
                shard = Shard(batch)
                n = np.bincount(shard.codes, minlength=len(shard.hashes))
                langs = shard.langs.take(pa.array(shard.lang_of)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(shard.hashes), langs, shard.vocabulary.take(pa.array(shard.word_of)).cast(pa.string()), pa.array(n, pa.int64())], names=["h", "lang", "word", "n"])
                own = np.bincount(shard.lang_of, weights=n, minlength=len(shard.langs)).astype(np.int64)
                # Under the number of the task, so that they spread over all tasks.
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), partition, np.int64)), shard.langs.cast(pa.string()), pa.nulls(len(own), pa.string()), pa.array(own)], names=["h", "lang", "word", "n"])

    counted = _texts(docs, text_col, lang_col).mapInArrow(run, "h long, lang string, word string, n long").repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))
    kinds = F.count("word").over(Window.partitionBy("h"))
    one = F.when(F.col("kinds") > 1, F.raise_error(F.lit("two words have one hash"))).otherwise(F.col("n"))
    return counted.withColumn("kinds", kinds).where((F.col("n") >= least) | F.col("word").isNull() | (F.col("kinds") > 1)).withColumn("n", one).drop("kinds")


def pair_counts(texts: DataFrame, words: Filter, ranges: Ranges, least: int) -> DataFrame:
    """(key, h1, h2, n) of the pairs with the least count."""
    known, cut = texts.sparkSession.sparkContext.broadcast(words.bits), texts.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SHARD_BYTES):
                shard = Shard(batch)
                frequent, rank = shard.ranked(Filter(known.value))
                piece = shard.runs.pieces()
                valid = (piece[1:] == piece[:-1]) & (rank[1:] >= 0) & (rank[:-1] >= 0)
                number, n = np.unique((rank[:-1] * len(frequent) + rank[1:])[valid], return_counts=True)
                columns = [frequent[x] for x in np.divmod(number, len(frequent))] if len(number) else [number, number]
                yield _dealt(cut.value, columns, n)

    def merge(table: pa.Table) -> pa.Table:
        (h1, h2), n = merged([paths(x.as_buffer().to_pybytes(), 2) for x in table.column("trie")])
        kept = n >= least
        h1, h2, n = h1[kept], h2[kept], n[kept]
        return pa.table({"key": path_key([h1, h2]).view(np.int64), "h1": h1, "h2": h2, "n": n})

    return texts.mapInArrow(run, "range long, trie binary").groupBy("range").applyInArrow(merge, "key long, h1 long, h2 long, n long")


def _dealt(ranges: Ranges, columns: list[np.ndarray], n: np.ndarray, parent: np.ndarray | None = None, below: np.ndarray | None = None, below_n: np.ndarray | None = None) -> pa.RecordBatch:
    """A shard's trie cut into ranges of prefixes."""
    to = ranges.of(columns)
    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0])) if len(order) else []
    out = []
    if below is not None:
        kids = np.bincount(parent, minlength=len(n))
        firsts = np.cumsum(kids) - kids
    for at in np.split(order, starts[1:]) if len(order) else []:
        more = ()
        if below is not None:
            k = kids[at]
            own = np.repeat(firsts[at] - np.cumsum(k) + k, k) + np.arange(k.sum())
            more = np.repeat(np.arange(len(at)), k), below[own], below_n[own]
        out.append(serialised([c[at] for c in columns], n[at], *more))
    return pa.RecordBatch.from_arrays([pa.array(to[order[starts]] if len(order) else [], pa.int64()), pa.array(out, pa.binary())], names=["range", "trie"])


def longer_counts(texts: DataFrame, words: Filter, pairs: Filter, ranges: Ranges, least: int) -> DataFrame:
    """(h1, h2, h3, h4, n) of phrases of three (h4 is 0) and four words with the least count."""
    sent = [texts.sparkSession.sparkContext.broadcast(x) for x in (words.bits, pairs.bits, ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SHARD_BYTES):
                shard = Shard(batch)
                frequent, rank = shard.ranked(Filter(sent[0].value))
                piece, size = shard.runs.pieces(), len(frequent)
                valid = np.flatnonzero((piece[1:] == piece[:-1]) & (rank[1:] >= 0) & (rank[:-1] >= 0))
                two, at_two = np.unique(rank[valid] * size + rank[valid + 1], return_inverse=True)
                first, second = (frequent[x] for x in np.divmod(two, max(1, size)))
                fine = Filter(sent[1].value).may_hold(path_key([first, second]))[at_two]
                # The number of the pair that begins at each word, or -1.
                begins = np.full(len(rank) + 2, -1, np.int64)
                begins[valid[fine]] = at_two[fine]
                at = np.flatnonzero((begins[:-1] >= 0) & (begins[1:] >= 0))
                three, at_three = np.unique(begins[at] * size + rank[at + 2], return_inverse=True)
                n = np.bincount(at_three, minlength=len(three))
                on = begins[at + 2] >= 0
                four, n_four = np.unique(at_three[on] * size + rank[at[on] + 3], return_counts=True)
                pair, third = np.divmod(three, max(1, size))
                parent, fourth = np.divmod(four, max(1, size))
                yield _dealt(sent[2].value, [first[pair], second[pair], frequent[third]], n, parent, frequent[fourth], n_four)

    def merge(table: pa.Table) -> pa.Table:
        tries = [x.as_buffer().to_pybytes() for x in table.column("trie")]
        out = []
        for depth in (3, 4):
            columns, n = merged([paths(x, depth) for x in tries])
            kept = n >= least
            out.append([*(c[kept] for c in columns), *([np.zeros(kept.sum(), np.int64)] if depth == 3 else []), n[kept]])
        return pa.table({c: np.concatenate(x) for c, *x in zip([*_PATH, "n"], *out, strict=True)})

    return texts.mapInArrow(run, "range long, trie binary").groupBy("range").applyInArrow(merge, "h1 long, h2 long, h3 long, h4 long, n long")


def walked(nodes: DataFrame) -> DataFrame:
    """nodes (lang for words alone, h1 to h4 with 0 below the depth, n) plus lang for all and l1, l2, l3, the counts of
    their ancestors at these depths, by one walk over the trie in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lang = [0, 0, 0], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in _PATH]
            depth = sum((c != 0).astype(np.int64) for c in columns)
            n, place = batch.column("n").to_numpy(), np.arange(batch.num_rows)
            above = []
            for d in (1, 2, 3):
                last = np.maximum.accumulate(np.where(depth == d, place, -1))
                above.append(np.where(last >= 0, n[last], counts[d - 1]))
                counts[d - 1] = int(above[-1][-1]) if batch.num_rows else counts[d - 1]
            langs = pc.fill_null(pc.fill_null_forward(batch.column("lang")), lang) if lang is not None else pc.fill_null_forward(batch.column("lang"))
            lang = langs[-1].as_py() if batch.num_rows else lang
            yield pa.RecordBatch.from_arrays([langs, *(batch.column(c) for c in [*_PATH, "n"]), *map(pa.array, above)], names=["lang", *_PATH, "n", "l1", "l2", "l3"])

    ordered = nodes.select("lang", *_PATH, "n").repartition("h1").sortWithinPartitions(*_PATH)
    return ordered.mapInArrow(run, "lang string, h1 long, h2 long, h3 long, h4 long, n long, l1 long, l2 long, l3 long")


def linked(trie: DataFrame) -> DataFrame:
    """The phrases of a walked trie plus r1, r2, r3, the counts of what is left of them without their first words, by suffix links."""
    level = [trie.where((F.col(_PATH[d]) != 0) & (F.col(_PATH[d + 1]) == 0) if d < 3 else F.col("h4") != 0) for d in range(4)]
    no = F.lit(None).cast("long")
    known = level[0].select("h1", F.col("n").alias("r1"), no.alias("r2"), no.alias("r3"))
    out = None
    for d in (1, 2, 3):
        # The path without its first word is a path of the level above.
        target = known.select(*(F.col(_PATH[i]).alias(_PATH[i + 1]) for i in range(d)), "r1", "r2", "r3")
        here = level[d].join(sent_if_small(target, SENT_ROWS) if d == 1 else target, _PATH[1 : d + 1])
        out = here if out is None else out.unionByName(here)
        known = here.select(*_PATH[: d + 1], F.col("n").alias("r1"), F.col("r1").alias("r2"), F.col("r2").alias("r3"))
    return out


def _score(a: Column, l: Column, r: Column) -> Column:
    return F.call_function("div", F.lit(SCALE).cast("decimal(8,0)") * a.cast("decimal(19,0)"), (l + r).cast("decimal(19,0)"))


def scored(phrases: DataFrame) -> DataFrame:
    """phrases with a, l, r and score of their lowest-scoring cut, without those that a longer phrase covers."""
    depth = F.when(F.col("h4") != 0, 4).when(F.col("h3") != 0, 3).otherwise(2)
    cuts = [F.when(depth > k, F.struct(_score(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)]
    cut = phrases.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", *_PATH, F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    longer = cut.where(F.col("h3") != 0)
    none = F.lit(0).cast("long")
    left = longer.select("h1", "h2", F.when(F.col("h4") != 0, F.col("h3")).otherwise(none).alias("h3"), none.alias("h4"), "a")
    right = longer.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), F.col("h4").alias("h3"), none.alias("h4"), "a")
    most = left.unionByName(right).groupBy(*_PATH).agg(F.max("a").alias("longer"))
    # A phrase two words longer covers it only if one between them does.
    return cut.join(most, _PATH, "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < COVERED * F.col("a").cast("decimal(20,0)"))).drop("longer")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of two to four words by the score of their weakest cut.

    Null texts are empty, a null language is und; repeated rows count each; phrases do not cross punctuation or line
    ends; equal scores go by count, then by spelling in byte order; an empty table gives no rows.
    """
    texts = _texts(docs, text_col, lang_col)
    words = saved(word_counts(docs, text_col, lang_col, least), "words")
    totals = words.where("word IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    spelled = words.where("word IS NOT NULL")
    size = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(5, (size // RANGE_WORDS).bit_length())
    hot = max(least, int(size * HOT_SHARE))
    hot_words = np.array([r.h for r in spelled.where(F.col("n") > hot).select("h").toLocalIterator()], np.int64)
    known = Filter.of(spelled.select("h"))
    pairs = saved(pair_counts(texts, known, Ranges(bits, hot_words, np.empty(0, np.int64)), least), "pairs")
    hot_pairs = np.array([r.key for r in pairs.where(F.col("n") > hot).select("key").toLocalIterator()], np.int64)
    longer = saved(longer_counts(texts, known, Filter.of(pairs.select("key")), Ranges(bits, hot_words, hot_pairs), least), "longer")
    zero, nowhere = F.lit(0).cast("long"), F.lit(None).cast("string").alias("lang")
    nodes = spelled.select("lang", F.col("h").alias("h1"), zero.alias("h2"), zero.alias("h3"), zero.alias("h4"), "n")
    nodes = nodes.unionByName(pairs.select(nowhere, "h1", "h2", zero.alias("h3"), zero.alias("h4"), "n")).unionByName(longer.select(nowhere, *_PATH, "n"))
    found = scored(linked(saved(walked(nodes), "trie")))
    best = saved(found.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place"), "best")
    parts = best.select(*_PATH, F.posexplode(F.array(*_PATH)).alias("pos", "h")).where("h <> 0").join(spelled.select("h", "word"), "h")
    names = parts.groupBy(*_PATH).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = best.join(names, _PATH).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return named.join(sent_if_small(totals, SENT_ROWS), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """DuckDB SQL for mine() with its default parameters."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    grams = " UNION ALL ".join(f"SELECT lang, list_slice(w, i, i + {k - 1}) AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)" for k in (1, 2, 3, 4))
    cuts = " UNION ALL ".join(f"SELECT c.lang, c.p, {k} AS k, c.f AS a, x.f AS l, y.f AS r FROM cand c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, {k}) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, {k + 1}, len(c.p)) WHERE len(c.p) > {k}" for k in (1, 2, 3))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
cut AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
f AS (SELECT lang, p, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
cand AS (SELECT * FROM f WHERE len(p) > 1),
cuts AS ({cuts}),
low AS (SELECT *, ({SCALE}::HUGEINT * a) // (l + r) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
subs AS (SELECT lang, f, unnest(CASE len(p) WHEN 3 THEN [p[1:2], p[2:3]] ELSE [p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]] END) AS p FROM cand WHERE len(p) > 2),
most AS (SELECT lang, p, max(f) AS longer FROM subs GROUP BY ALL),
kept AS (SELECT l.*, array_to_string(l.p, ' ') AS phrase FROM low l LEFT JOIN most m ON m.lang = l.lang AND m.p = l.p WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {TOP}"""
