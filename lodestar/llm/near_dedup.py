"""Near-duplicate documents by bottom-k sketches, inverted lists of retained values and exact Jaccard.

One 64-bit hash per shingle. A document keeps its k smallest; documents with the same whole set are one class,
and only the class's smallest id goes on. The first LISTED values of two linked sets overlap in at least a known
number, so, with the values ordered by how many classes retain them, rarest first, linked classes share one within
short prefixes of that order: these make the inverted lists. Values that one class alone retains list nothing, and
passages that many documents share come last in the order, so lists stay short but for groups of near copies.
There all meet their lists' best-known classes first, in rounds; what these links have not joined into one
component then meets across components, so groups never make all their pairs, yet no pair that could join two
components goes unseen. The union of two sketches estimates their similarity and filters; full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Words, as_array, byte_table, drop_saved, give_back, hashes, mixed, saved, sent_if_small, slices, translated, windows

SHINGLE, PERCENT = 4, 80
#: Values in a sketch; of these, the first LISTED are compared by lists.
RETAINED, LISTED = 192, 32
#: Probability with which a linked pair may share too few of the first LISTED values of its union.
MISSED = 1e-9
#: Best-known classes of a list, by a hash of their ids, that the others meet in the second round.
SALTS = 4
#: Standard deviations of the estimate below percent that still go on to exact verification.
DEVIATIONS = 4.9
#: Rows of ids that are sent to all tasks at most (some 40 bytes each); more of them are shuffled.
SENT_ROWS = 300_000
#: Tasks that write what is at most SENT_ROWS narrow rows, and tasks that compare at most that many pairs of full sets, where more would only cost their starts.
FEW, SOME = 8, 48
TABLE = byte_table()
#: Bytes of text whose shingles are made at once.
SLICE_BYTES = 2 << 20


def shingles(words: Words, hashed: np.ndarray, i: int, n: int) -> np.ndarray:
    """The sorted distinct hashes of row i's n-word shingles; fewer words make one shingle, none make none."""
    own = hashed[words.row(i)]
    if 0 < len(own) < n:
        return windows(own, len(own)) ^ np.uint64(len(own))
    return np.unique(windows(own, n))


def _set_hash(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(s)).astype(np.int64)) if len(s) else 0


def _each(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    words = Words(translated(as_array(batch.column("t")), TABLE))
    hashed = mixed(hashes(words.vocabulary))
    for i in range(len(words)):
        yield shingles(words, hashed, i, n)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Per document: doc_id, n_shingles, two hashes of the whole set, its smallest values, and its sketch (the upper halves of more of them), both ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                size, a, b, listed, kept = [], [], [], [], []
                for s in _each(batch, shingle):
                    size.append(len(s))
                    a.append(_set_hash(s))
                    b.append(int(mixed(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    signed = (s[:RETAINED] ^ np.uint64(1 << 63)).astype(np.int64)  # in the order of the hash
                    listed.append(signed[:LISTED])
                    kept.append((signed >> 32).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(listed, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "set_a", "set_b", "listed", "sketch"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, listed array<long>, sketch array<int>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row of (i, t, want) whose set has the hash want: doc_id and the packed sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                sets = list(_each(batch, shingle))
                right = pa.array([_set_hash(s) == want for s, want in zip(sets, batch.column("want").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "packed"]).filter(right)
        give_back()

    return docs.mapInArrow(run, f"doc_id {docs.schema['i'].dataType.simpleString()}, packed binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, size_a, size_b), those whose full sets are similar enough, as (a, b)."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_of_a"), batch.column("set_of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    few = pairs.count() <= SENT_ROWS
    full = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("packed").alias("set_of_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("packed").alias("set_of_b")), "b")
    return (full.coalesce(SOME) if few else full).mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node reachable.

    Each round gives a node the smallest label around it and then what was that label's label, until nothing changes;
    rounds follow the logarithm of the longest path about. Labels are sent to all tasks while edges are few.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    few = both.count() <= SENT_ROWS
    sent = lambda df, *columns: F.broadcast(df.select(*columns)) if few else df.select(*columns)
    kept = lambda df: saved(df.coalesce(FEW) if few else df, "labels")
    node, component = F.col("node"), F.col("component")
    labels = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(sent(labels, node.alias("b"), component), "b").groupBy("a").agg(F.min("component").alias("near"))
        closer = near.join(sent(labels, node.alias("a"), component.alias("before")), "a").select(F.col("a").alias("node"), "before", F.least("before", "near").alias("component"))
        moved = kept(closer.join(sent(labels, node.alias("component"), component.alias("jump")), "component").select("node", "before", F.col("jump").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("before <> component").isEmpty():
            drop_saved(both)
            return labels


def _sure(percent: int) -> int:
    """How many of the first LISTED values of their union two linked sets share, but for a chance of MISSED."""
    p, tail, t = percent / 100, 0.0, 0
    while t <= LISTED and (tail := tail + comb(LISTED, t) * p**t * (1 - p) ** (LISTED - t)) <= MISSED:
        t += 1
    return max(1, t)


def _overlap(n: Column, percent: int) -> Column:
    """How many of its first LISTED values a set of n shares with those of any set that is linked to it, at least.

    The union of the two has at most 100 n / percent values, and of any LISTED of them no more than the unshared
    ones are missing; whole sets share percent of n.
    """
    apart = F.floor(n * (100 - percent) / percent).cast("int")
    whole = F.least(F.ceil(n * percent / 100).cast("int"), LISTED - apart)
    return F.when(n <= LISTED, F.greatest(whole, F.lit(1))).otherwise(F.greatest(F.lit(_sure(percent)), LISTED - apart))


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(list, doc_id, n_shingles, known, left, before, hottest) for every prefix value that two classes or more retain.

    known sums over a class's values how many retain them. left is how many values stand from this one on, before
    has the class's earlier lists, so that two classes meet only in the first list they share; hottest marks
    the last list of a class.
    """
    values = classes.select("doc_id", F.explode("listed").alias("key"))
    counts = values.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = values.join(counts, "key").groupBy("doc_id").agg(F.sum("n").alias("known"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("held"))
    held = held.join(classes.select("doc_id", "n_shingles", F.size("listed").alias("size")), "doc_id")
    # Values that no other class retains come first in the order.
    most = F.col("size") - _overlap(F.col("n_shingles"), percent) + 1 - (F.col("size") - F.size("held"))
    prefix = held.where(most > 0).select("doc_id", "n_shingles", "known", F.size("held").alias("of"), F.slice("held.key", 1, F.greatest(most, F.lit(0))).alias("keys"))
    each = prefix.select("*", F.posexplode("keys").alias("at", "list"))
    listed = each.select("list", "doc_id", "n_shingles", "known", (F.col("of") - F.col("at")).alias("left"), F.slice("keys", 1, F.col("at")).alias("before"), (F.col("at") == F.size("keys") - 1).alias("hottest"))
    return saved(listed, "listed")


def _places_fit(percent: int) -> Column:
    """Whether rows x and y that meet first in this list have enough values from it on for a link."""
    return F.least("x.left", "y.left") >= F.greatest(_overlap(F.col("x.n_shingles"), percent), _overlap(F.col("y.n_shingles"), percent))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _least_share(x: str, y: str, percent: int) -> Column:
    """The share of the union's retained values that a linked pair's sketches have in common, at least.

    These values are a sample without replacement of the union, which has at most (x + y) / (1 + percent / 100)
    shingles if the pair is linked; so the estimate scatters less the more of the union it sees, and not at all if
    it sees all. One part in a hundred is left for chance equality of half hashes.
    """
    p = percent / 100
    most = (F.col(f"{x}n_shingles") + F.col(f"{y}n_shingles")) / (1 + p)
    seen = F.least(most, F.lit(float(RETAINED)))
    return p - 0.01 - DEVIATIONS * F.sqrt(p * (1 - p) / seen * (1 - seen / most))


def _enough_shared(x: str, y: str, percent: int) -> Column:
    """Whether two sketches share as many values as those of a linked pair; the union of whole sets follows from their sizes."""
    a, b, p = f"{x}sketch", f"{y}sketch", percent / 100 - 0.01
    whole = F.greatest(F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles")) <= RETAINED
    need = F.when(whole, p / (1 + p) * (F.size(a) + F.size(b))).otherwise(_least_share(x, y, percent) * F.greatest(F.size(a), F.size(b)))
    return F.size(F.array_intersect(a, b)) >= need


def _estimate_fits(x: str, y: str, percent: int) -> Column:
    """Whether the smallest values of the union of two sketches are shared often enough."""
    a, b = f"{x}sketch", f"{y}sketch"
    whole = F.greatest(F.col(f"{x}n_shingles"), F.col(f"{y}n_shingles")) <= RETAINED
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, RETAINED)
    sampled = F.size(F.array_intersect(F.array_intersect(a, b), union)) >= _least_share(x, y, percent) * F.size(union)
    return _enough_shared(x, y, percent) & (whole | sampled)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept (is that id its own).

    Links join documents with 100 * |intersection| >= percent * |union| of their distinct shingles. Null, empty
    and white-space texts have no shingles and no links. Rows with a null id stand alone, kept, with a null
    component. Rows with equal ids share a component; of their different sets the first by hash is compared.
    """
    every = saved(sketches(docs, id_col, text_col, shingle), "sketches")
    same = ["n_shingles", "set_a", "set_b"]
    named = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    heads = saved(named.groupBy(*same).agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")), "heads")
    # Different sets of this similarity have a union of least 100 / (100 - percent) shingles, so smaller ones need no lists.
    least = max(1, -(-100 // max(1, 100 - percent)) - 1)
    chosen = heads.where(F.col("n_shingles") >= least).groupBy(F.col("head").alias("doc_id")).agg(F.min(F.struct(*same)).alias("s")).select("doc_id", "s.*")
    classes = saved(named.join(chosen, ["doc_id", *same]).dropDuplicates(["doc_id"]).select("doc_id", "set_a", "n_shingles", "listed", "sketch"), "classes")

    lists = _lists(classes, percent)
    verify = lambda pairs: _verified(docs, id_col, text_col, shingle, percent, pairs, classes)
    best = lambda *more: F.max(F.struct("known", "doc_id", "n_shingles", *more)).alias("leader")

    # In a first round each class meets the best-known one of its most common list.
    hot = lists.where("hottest")
    links = verify(_led(hot, hot.groupBy("list").agg(best()), percent))
    labels = components(links)
    # Then, wherever a list has several components, the best-known of each salt.
    known = _several(lists, labels)
    salted = known.groupBy("list", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(best("component"))
    more = verify(_led(known, salted, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    # Then all that is left, across components.
    met = saved(_several(lists, labels).join(classes.select("doc_id", "sketch"), "doc_id"), "met")
    x, y = met.alias("x"), met.alias("y")
    rest = x.join(
        y,
        (F.col("x.list") == F.col("y.list")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
        & _sizes_fit("x.n_shingles", "y.n_shingles", percent) & _places_fit(percent) & ~F.arrays_overlap("x.before", "y.before") & _enough_shared("x.", "y.", percent),
    ).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    more = verify(rest)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    drop_saved(met, lists)

    named_heads = heads.join(labels.withColumnRenamed("node", "head"), "head", "left").select(*same, F.coalesce("component", "head").alias("component"))
    out = every.drop("listed", "sketch").join(named_heads, same, "left")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _led(lists: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's leaders and its classes, of other components if there are any yet."""
    known = "component" in lists.columns
    leaders = saved(leaders.select("list", "leader.doc_id", "leader.n_shingles", *(["leader.component"] if known else [])), "leaders")
    x, y = sent_if_small(leaders, SENT_ROWS).alias("x"), lists.alias("y")
    apart = F.col("x.component") != F.col("y.component") if known else F.col("x.doc_id") != F.col("y.doc_id")
    met = y.join(x, (F.col("x.list") == F.col("y.list")) & apart & _sizes_fit("x.n_shingles", "y.n_shingles", percent))
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _several(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that have classes of several components, with these."""
    own = lists.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    own = saved(own, "known")
    several = saved(own.groupBy("list").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("list"), "several")
    return own.join(sent_if_small(several, SENT_ROWS), "list", "left_semi")


def _verified(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidate pairs that full sets, made again from the texts that need it confirm, of those that the estimate leaves."""
    x, y = (classes.select(F.col("doc_id").alias(c), F.struct("sketch", "n_shingles").alias(f"of_{c}")) for c in ("a", "b"))
    pairs = pairs.join(x, "a").join(y, "b").where(_estimate_fits("of_a.", "of_b.", percent)).select("a", "b")
    pairs = saved(pairs, "candidates")
    n = pairs.count()
    if not n:
        return pairs
    needed = pairs.select(F.explode(F.array("a", "b")).alias("i"))
    needed = F.broadcast(needed) if 2 * n <= SENT_ROWS else needed.distinct()
    wanted = saved(classes.select(F.col("doc_id").alias("i"), F.col("set_a").alias("want")).join(needed, "i", "left_semi"), "wanted")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(sent_if_small(wanted, SENT_ROWS), "i")
    sets = saved(shingle_sets(texts, shingle).dropDuplicates(["doc_id"]), "sets")
    links = saved(_linked(pairs, sets, percent), "links")
    drop_saved(pairs, wanted, sets)
    return links


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs without the near duplicates that groups() marks: of each component the smallest id stays, with all columns.

    Texts without words, null ones among them, are linked with nothing and stay; rows of one id are one document and stay
    or go together; an empty table stays empty.
    """
    out = groups(docs, id_col, text_col, shingle, percent).where("NOT kept").select(F.col("doc_id").alias("__near_duplicate")).distinct()
    return docs.join(out, docs[id_col] == out["__near_duplicate"], "left_anti")
