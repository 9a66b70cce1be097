"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all normalised items reads a document's words and tracks the longest suffix that occurs in
an item. A suffix of at least `window` words is a hit; a shorter item counts as one window of its own length.
Only runs of words that items use can match, so the automaton reads those runs alone. Items are split into
blocks of bounded size. Tasks build an automaton of each block once and write it to the shared folder; the tasks
that read documents load one automaton at a time, for all texts that they hold. Every document meets every block.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, as_array, byte_table, filesystem, give_back, new_path, numbered, slices, translated

WINDOW = 10
#: Words of items in one automaton, about (1 kB each in a task): the bound of what a task holds of the items.
BLOCK_WORDS = 200_000
#: Bytes of texts that meet each loaded automaton, if there are several.
HELD_BYTES = 32 << 20
#: ASCII bytes that are no letter or digit separate words, and A-Z count as a-z.
TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        #: Only while building; then `step` has all transitions, by state and word.
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.least = min([window, *(len(words) for _, words in numbered)])
        #: Items of the window that ends a match in this state, and of short items that end there by length.
        self.items: dict[int, set[str]] = defaultdict(set)
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, words in numbered:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items[self.at_length(state, window)].add(name)
            if len(words) < window:
                self.short.setdefault(self.at_length(state, len(words)), {}).setdefault(len(words), set()).add(name)
        self.step = {(state << 32) | w: target for state, following in enumerate(self.next) for w, target in following.items()}
        self.next = []

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            target = self.next[last][w]
            return target if self.longest[target] == self.longest[last] + 1 else self._split(last, w, target)
        made = self._state(self.longest[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            target = self.next[p][w]
            self.link[made] = target if self.longest[target] == self.longest[p] + 1 else self._split(p, w, target)
        else:
            self.link[made] = 0
        return made

    def _state(self, longest: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.longest.append(longest)
        self.link.append(0)
        return len(self.longest) - 1

    def _split(self, p: int, w: int, target: int) -> int:
        made = self._state(self.longest[p] + 1, dict(self.next[target]))
        self.link[made], self.link[target] = self.link[target], made
        while p >= 0 and self.next[p].get(w) == target:
            self.next[p][w] = made
            p = self.link[p]
        return made

    def at_length(self, state: int, length: int) -> int:
        """The state of the suffix of this length."""
        while self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of words inside occurrences of windows, in order of their ends, and the items."""
        spans, found = [], set()
        state = length = 0
        for i, w in enumerate(words):
            target = self.step.get((state << 32) | w)
            while target is None and state:
                state = self.link[state]
                length = self.longest[state]
                target = self.step.get((state << 32) | w)
            if target is None:
                continue
            state, length = target, length + 1
            if length >= self.window:
                found |= self.items[self.at_length(state, self.window)]
                spans.append((i + 1 - self.window, i + 1))
            if self.short:
                at, most = state, 0
                while at > 0:
                    for size, names in self.short.get(at, {}).items():
                        if size <= length:
                            found |= names
                            most = max(most, size)
                    at = self.link[at]
                if most:
                    spans.append((i + 1 - most, i + 1))
        return spans, found


def match(texts: pa.Array, automaton: Automaton) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """Of each text: its number of words, the spans of hits, the items."""
    words = Words(translated(texts, TABLE))
    numbers = np.fromiter((automaton.vocabulary.get(w, -1) for w in words.vocabulary.to_pylist()), np.int64, len(words.vocabulary))
    numbered = numbers[words.codes] if len(words.codes) else np.empty(0, np.int64)
    for i in range(len(words)):
        own = numbered[words.starts[i] : words.starts[i + 1]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own >= 0, [0]])))
        spans, found = [], set()
        for a, b in edges.reshape(-1, 2)[edges[1::2] - edges[::2] >= automaton.least].tolist():
            got, names = automaton.hits(own[a:b].tolist())
            spans += [(a + x, a + y) for x, y in got]
            found |= names
        yield len(own), spans, found


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans united where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Blocks:
    """The automata of items in the shared folder, as tasks read them."""

    def __init__(self, folder: str, numbers: list[int], window: int):
        self.folder, self.numbers, self.window = folder, numbers, window
        self._held: tuple[int, Automaton] | None = None

    def _automaton(self, number: int) -> Automaton:
        if self._held is None or self._held[0] != number:
            self._held = None
            import pyarrow.parquet as pq
            from pyarrow.fs import FileSelector

            files, root = filesystem(self.folder)
            (file,) = (f.path for f in files.get_file_info(FileSelector(f"{root}/block={number}")) if f.path.endswith(".parquet"))
            self._held = number, pickle.loads(pq.ParquetFile(file, filesystem=files).read().column("automaton")[0].as_py())
        return self._held[1]

    def matches(self, texts: pa.Array) -> tuple[list[int], list[list[list[int]]], list[set[str]]]:
        """Of each text: its number of words, its merged spans of hits, the items found."""
        sizes, spans, items = [0] * len(texts), [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
        for automaton in map(self._automaton, self.numbers) if self.numbers else [Automaton([], self.window)]:
            for i, (n, got, names) in enumerate(match(texts, automaton)):
                sizes[i] = n
                spans[i] += got
                items[i] |= names
        return sizes, [merged(s) for s in spans], items

    @property
    def batch_bytes(self) -> int:
        return HELD_BYTES if len(self.numbers) > 1 else 2 << 20


def blocks_of(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> Blocks:
    """Automata of the items, each built once by a task, of about block_words words; a longer item is never cut.

    A null id is an empty one; null texts and texts without words are left out; repeated rows count once.
    """
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    total = own.agg(F.sum(F.size(F.split("t", BETWEEN)))).first()[0]
    if not total:
        return Blocks("", [], window)
    number = F.pmod(F.xxhash64("i", "t"), F.lit(-(-total // block_words))).cast("int")

    def build(table: pa.Table) -> pa.Table:
        words = Words(translated(as_array(table.column("t")), TABLE))
        spelled = words.vocabulary.to_pylist()
        automaton = Automaton([(name, [spelled[c] for c in words.row(k).tolist()]) for k, name in enumerate(table.column("i").to_pylist())], window)
        return pa.table({"block": table.column("block")[:1], "automaton": pa.array([pickle.dumps(automaton)], pa.binary())})

    folder = new_path(items.sparkSession, "automata")
    own.withColumn("block", number).groupBy("block").applyInArrow(build, "block int, automaton binary").write.partitionBy("block").parquet(folder)
    made = items.sparkSession.read.schema("block int").option("basePath", folder).parquet(folder)
    return Blocks(folder, sorted(r.block for r in made.distinct().collect()), window)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged [from, to) word spans).

    Null and empty texts have no words and no hits, as have all documents where there are no items; repeated
    rows are judged each; items with equal texts are all found. One pass and no shuffle for each row, whatever
    the number of blocks.
    """
    blocks = blocks_of(items, item_id, item_text, window, block_words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", blocks.batch_bytes):
                sizes, spans, found = blocks.matches(as_array(batch.column("t")))
                names = [sorted(f) for f in found]
                hit = [sum(b - a for a, b in s) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("i"), pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in names], pa.string()), pa.array([n > 0 for n in hit], pa.bool_()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )
        give_back()

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the spans of hits cut out of their texts; a document is dropped if more than max_coverage of its words are hit.

    All columns stay, under any names; n_chars, if there is one, follows the text. A cut leaves one space; the rest of a
    text stays as it is. Null and empty texts stay; repeated rows are cut each; items without words and an empty table
    of items change nothing; an empty table stays empty.
    """
    own, text_at = numbered(docs), docs.columns.index(text_col)
    text_name, chars_at = f"c{text_at}", docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    blocks = blocks_of(items, item_id, item_text, window, block_words)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def cut(text: str, spans: list[list[int]]) -> str:
        import re

        at = [m.span() for m in re.finditer(word, text)]
        out, begin = [], 0
        for a, b in spans:
            out.append(text[begin : at[a][0]])
            begin = at[b - 1][1]
        return " ".join([*out, text[begin:]]).strip(" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_name, blocks.batch_bytes):
                column = batch.column(text_name)
                sizes, spans, _ = blocks.matches(as_array(column))
                keep = [sum(b - a for a, b in s) <= max_coverage * n for s, n in zip(spans, sizes, strict=True)]
                values = [cut(t, s) if s and k else t for t, s, k in zip(column.to_pylist(), spans, keep, strict=True)]
                columns = list(batch.columns)
                columns[text_at] = pa.array(values, column.type)
                if chars_at >= 0:
                    columns[chars_at] = pc.utf8_length(columns[text_at]).cast(columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))
        give_back()

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
