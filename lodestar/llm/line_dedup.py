"""Line dedup: an exact set-similarity join of lines, after which lines that match an earlier one go.

A line is the set of its lower-cased words, told apart by 64-bit hashes. Lines of equal sets are one class, found
by two hashes of the set, and the class's first occurrence stands for it. Words are ordered by rarity (exact counts
of frequent words in a table of fixed size, then the word's hash); sets of similarity 0.8 share a word in short
prefixes of that order. First the classes of all but small groups whose prefixes end with the same two words, or have the same two before
the last, meet the group's earliest one: this finds a match for most members of groups of near copies, in rows in proportion to classes.
Then each prefix word lists its classes, with their sizes, positions and parity words, all of which bound the overlap a pair can still have; full sets decide.
Pairs of a short list in which one has no match yet meet directly; the smaller set of a pair needs but a part of its prefix. Classes of a long list go on to lists of two prefix
words. Where such a list is long too, all meet its earliest class and its commonest
one, and only those still without a match meet all, so groups of near copies never make all their pairs. All of it
is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_saved, saved, sent_if_small

PERCENT = 80
#: Counters of the rarity table, a power of two: its size does not depend on the input.
COUNTERS = 1 << 21
#: Words are frequent from this share of all occurrences on, so that there are never more of them, and from this count on.
SHARE, LEAST_FREQUENT = 1 << 21, 32
#: Bits of a word's hash in its key; the bits above hold log2 of its count, 0 where it is not frequent.
HASH_BITS = 52
#: A list of more classes than this is long.
LONG = 1024
#: Keys of long lists that are sent to all tasks at most (8 bytes each).
SENT_KEYS = 1_000_000
#: Entries for each class that are shuffled at once: lists are dealt to as many passes as that takes, so room stays in proportion.
AT_ONCE = 8
#: Leaders of each kind in the later rounds over long lists.
SALTS = 8
#: Pairs of neighbouring last prefix words by which classes meet the earliest one before all else.
LEADING = 2
#: Sets of more words than this have a parity of 256 bits too: of 64 bits, hardly more differ by chance than may differ.
WIDE = 112
#: Groups of more classes than this that have such a pair in common meet their earliest one; smaller ones make few pairs anyway.
LED = 8
#: Lines to cut whose numbers are sent to all tasks at most (4 bytes each and some 50 a document); beyond that, texts are shuffled.
CUT_LINES = 1_000_000
#: Lines to verify that are sent to all tasks at most (some 40 bytes each); beyond that, their sets are shuffled.
SENT_LINES = 300_000
#: White space besides line feeds.
_SPACE = " \t\v\f\r"
#: Larger dictionaries than usual, as hashes of frequent words repeat and nothing else makes them smaller.
_DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}
#: For tables of words of whole lines: looking each up in a dictionary costs more than zstd's own search for what repeats.
_PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("n", "a", "b", "words.list.element", "line.words.list.element")}


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that has a word: n (a number), rep (id, hash of the text, line number), a and b (hashes of the set), size, words (sorted hashes)."""
    text = F.col(text_col)
    odd = [c for c in _SPACE if c != " "]
    spaced = F.when(F.rlike(text, F.lit(f"[{''.join(odd)}]")), F.translate(text, "".join(odd), " " * len(odd))).otherwise(text)
    # Texts are hashed before they are exploded, once each and not once a line; split in the generator, they are split once, as no filter is inferred from it.
    whole = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("of"), spaced.alias("spaced"))
    each = whole.select("doc", "of", F.posexplode(F.split("spaced", "\n")).alias("no", "line"))
    lines = each.select("doc", "of", "no", F.trim("line").alias("line")).where("line <> ''")
    # Split at single spaces, which needs no pattern; what lies between two spaces in a row is no word.
    hashed = F.transform(F.split(F.lower("line"), " "), lambda w: F.xxhash64(w))
    words = F.array_remove(F.array_distinct(F.sort_array(hashed)), F.xxhash64(F.lit("")))
    sets = lines.select("doc", "of", "no", words.alias("words"))
    return sets.select(F.monotonically_increasing_id().alias("n"), F.struct("doc", "of", "no").alias("rep"), F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"), F.size("words").alias("size"), "words")


def _rarity(lines: DataFrame, frequent: int) -> DataFrame:
    """One row with one array: for each counter log2 of the lines that the commonest of its frequent words is in, 0 without one."""
    words = lines.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= frequent)
    each = words.groupBy(F.col("w").bitwiseAND(COUNTERS - 1).cast("int").alias("counter")).agg(F.max("n").alias("n"))
    dense = lines.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("counter")).join(each, "counter", "left")
    value = F.floor(F.log2(F.coalesce("n", F.lit(1)).cast("double"))).cast("tinyint")
    parts = dense.groupBy(F.shiftright("counter", 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("counter", value.alias("value")))).alias("values"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("part", F.col("values.value").alias("values")))).alias("parts"))
    return saved(parts.select(F.flatten("parts.values").alias("rarity")), "rarity")


def _keys(words: Column, rarity: Column) -> Column:
    """The sorted keys of a set's words: rarest first, in one order for all lines."""
    def key(h: Column) -> Column:
        rare = F.get(rarity, h.bitwiseAND(COUNTERS - 1).cast("int")).cast("long")
        # Keys that cannot be null are sorted as numbers, not as objects.
        return F.coalesce(F.shiftleft(rare, HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(words, key))


def _parity(words: Column) -> Column:
    """64 bits, of which each word of a set turns one: sets differ in at least as many words as in bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(63).cast("int"))))


def _wide_parity(words: Column) -> Column:
    """As _parity(), in 256 bits, for sets too large for one number: three numbers, as the fourth is what _parity() has besides."""
    one = F.lit(1).cast("long")

    def part(k: int) -> Column:
        turned = lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(63).cast("int")))
        return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.when(w.bitwiseAND(192) == 64 * k, turned(a, w)).otherwise(a))

    return F.array(*(part(k) for k in range(3)))


def _wide_apart() -> Column:
    """How many of 256 bits of parity differ between x and y; null where one of them has 64 alone."""
    parts = [F.col("wide_x")[k].bitwiseXOR(F.col("wide_y")[k]) for k in range(3)]
    parts.append(reduce(lambda a, b: a.bitwiseXOR(b), parts, F.col("bits_x").bitwiseXOR(F.col("bits_y"))))
    return reduce(add, map(F.bit_count, parts))


def _prefix(size: Column, percent: int) -> Column:
    """Length of the prefix in which sets of this size share a word with any set similar enough."""
    return size - F.ceil(size * percent / 100).cast("int") + 1


def _smaller(percent: int, shared: int = 1) -> Column:
    """Whether an entry (size, at) of a list of `shared` words lies where a set shares its first words with any set of its size or larger."""
    # The overlap is percent / (100 + percent) of both sizes, and so of twice the smaller one, at least.
    return F.col("at") < F.col("size") - F.ceil(F.col("size") * (2 * percent) / (100 + percent)).cast("int") + shared


def _fit(percent: int, shared: int = 1, ordered: bool = False) -> Column:
    """Length, positional and parity filters for entries x and y (size, at, bits) of one list of `shared` words; ordered: x is not the larger one."""
    small, large = (F.col("x.size"), F.col("y.size")) if ordered else (F.least("x.size", "y.size"), F.greatest("x.size", "y.size"))
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + (shared - 1)
    both = F.col("x.size") + F.col("y.size")
    apart = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))
    # Overlap o must reach percent / (100 + percent) of both sizes; it is at most left, and (both - apart) / 2.
    return (100 * small >= percent * large) & ((100 + percent) * left >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both)


def _confirmed(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of line numbers, those whose full sets are similar enough, as rep and n of the later line."""
    pairs = saved(pairs.distinct(), "pairs")
    needed = saved(pairs.select(F.explode(F.array("x", "y")).alias("n")).distinct(), "needed")
    sets = lines.join(sent_if_small(needed, SENT_LINES), "n", "left_semi").select("n", F.struct(F.struct("rep", "n").alias("own"), "words").alias("line"))
    sets = saved(sets, "sets", **_PLAIN)
    full = pairs.join(sets.withColumnsRenamed({"n": "x", "line": "of_x"}), "x").join(sets.withColumnsRenamed({"n": "y", "line": "of_y"}), "y")
    both = F.size(F.array_intersect("of_x.words", "of_y.words"))
    found = full.where(100 * both >= percent * (F.size("of_x.words") + F.size("of_y.words") - both))
    found = saved(found.select(F.greatest("of_x.own", "of_y.own").alias("later")).distinct().select("later.*"), "matched")
    drop_saved(pairs, needed, sets)
    return found


def _confirmed_once(pairs: DataFrame, classes: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """As _confirmed() for later lines that are open: one pair of each first, then all pairs of those that this leaves without a match."""
    of = lambda c: classes.select(F.col("n").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("size", "bits", "wide", "open")), F.col("rep").alias(f"of_{c}"))
    both = F.col("size_x") + F.col("size_y")
    fits = F.coalesce((100 + percent) * (both - _wide_apart()) >= 2 * percent * both, F.lit(True))
    swap = F.col("of_x") > F.col("of_y")
    # A later line that has a match already needs no other.
    in_order = pairs.distinct().join(of("x"), "x").join(of("y"), "y").where(fits & F.when(swap, F.col("open_x")).otherwise(F.col("open_y")))
    in_order = saved(in_order.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y")), "in_order")
    first = saved(in_order.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "first")
    one = _confirmed(first, lines, percent)
    rest = in_order.join(one.select(F.col("n").alias("y")), "y", "left_anti").join(first, ["x", "y"], "left_anti")
    two = _confirmed(rest, lines, percent)
    drop_saved(in_order, first)
    return one.unionByName(two)


def _meeting(x: DataFrame, y: DataFrame, fit: Column) -> DataFrame:
    """Numbers of the pairs of entries of one list that fit, the smaller as x."""
    met = x.alias("x").join(y.alias("y"), F.col("x.key") == F.col("y.key")).where(fit)
    return met.select(F.least("x.n", "y.n").alias("x"), F.greatest("x.n", "y.n").alias("y"))


def _ends(classes: DataFrame) -> DataFrame:
    """Classes by the pairs of neighbouring last words of their prefixes, LEADING each at most: key (a hash), own."""
    # The words need not be the first that two of them share, so their place bounds nothing.
    own = F.struct("rep", "n", "size", F.lit(0).alias("at"), "bits")
    keys = F.array(*(F.when(F.size("prefix") >= k, F.xxhash64(F.slice("prefix", -k, 2))) for k in range(2, 2 + LEADING)))
    return classes.where(F.size("prefix") > 1).select(F.explode(keys).alias("key"), own.alias("own")).where("key IS NOT NULL")


def _with_earliest(ends: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes with the earliest one of each of the groups (keys) that they are in."""
    ends = ends.join(sent_if_small(groups, SENT_KEYS), "key", "left_semi")
    leaders = ends.groupBy("key").agg(F.min("own").alias("own"))
    return _meeting(leaders.select("key", "own.*"), ends.select("key", "own.*"), _fit(percent) & (F.col("x.n") != F.col("y.n")))


def _led(members: DataFrame, percent: int, shared: int, salts: int) -> DataFrame:
    """The pairs of a list's leaders with the others that have no match yet; leaders are the earliest and the commonest class of each salt."""
    own = F.struct("n", "size", "at", "bits")
    ends = members.groupBy("key", F.pmod(F.xxhash64("n"), F.lit(salts))).agg(F.min(F.struct("rep", own.alias("own"))).alias("first"), F.max(F.struct("score", own.alias("own"))).alias("common"))
    leaders = ends.select("key", F.explode(F.array("first.own", "common.own")).alias("own")).distinct().select("key", "own.*")
    return _meeting(leaders, members.where("open"), _fit(percent, shared) & (F.col("x.n") != F.col("y.n")))


def _still_open(members: DataFrame, matched: DataFrame) -> DataFrame:
    """members, open where they were and their rep is not among the matched ones."""
    return members.join(sent_if_small(matched.select("rep").distinct(), SENT_LINES).withColumn("matched", F.lit(True)), "rep", "left").withColumn("open", F.col("open") & F.col("matched").isNull()).drop("matched")


def _passes(lists: DataFrame, rows: int | None, classes: int) -> list[DataFrame]:
    """lists, of so many rows, in parts of about AT_ONCE rows a class that each have all of a key's rows."""
    n = -(-(rows or 0) // max(1, AT_ONCE * classes))
    return [lists.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k) for k in range(n)] if n > 1 else [lists]


def _two_words(classes: DataFrame, long: DataFrame, percent: int) -> tuple[DataFrame, int | None]:
    """The classes of long lists listed by two prefix words, and the number of rows: key (a hash), n, size, at (the second word's place), bits, open."""
    # Two sets that share the list's word first share another one by the place after their prefixes.
    listed = classes.select("n", "size", "bits", "open", "prefix", F.posexplode("prefix").alias("before", "first")).where(F.col("before") < _prefix(F.col("size"), percent))
    listed = listed.join(sent_if_small(long.withColumnRenamed("key", "first"), SENT_KEYS), "first", "left_semi")
    rows = listed.agg(F.sum(F.size("prefix") - F.col("before") - 1)).first()[0]
    pair = listed.select("first", "n", "size", "bits", "open", "before", F.posexplode("prefix").alias("at", "second")).where("at > before")
    return pair.select(F.xxhash64("first", "second").alias("key"), "n", "size", "at", "bits", "open"), rows


def _by_leaders(classes: DataFrame, listed: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The reps of later lines of matches in lists of two words that are long too."""
    score = F.aggregate("prefix", F.lit(0.0), lambda a, k: a + F.shiftrightunsigned(k, HASH_BITS)) / F.greatest(F.size("prefix"), F.lit(1))
    members = saved(listed.join(classes.select("n", "rep", score.alias("score")), "n"), "members", **_DICTIONARY)
    one = _confirmed(_led(members, percent, 2, 1), lines, percent)
    two = _confirmed(_led(_still_open(members, one), percent, 2, SALTS), lines, percent)
    y = _still_open(members, one.unionByName(two)).where("open")
    rest = _confirmed(_meeting(members, y, _fit(percent, 2) & (F.col("x.rep") < F.col("y.rep"))), lines, percent)
    drop_saved(members)
    return one.unionByName(two).unionByName(rest)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, no) of every line occurrence that has an earlier match, by the rules of matches_by_text()."""
    return matches_by_text(docs, id_col, text_col, percent).select("doc", "no")


def matches_by_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc, of, no) of every line occurrence that has an earlier match: the document's id, its text's xxhash64, the line's number.

    Order is by (id, hash of the text, line number); null ids come first. Lines without a word never match. Null
    texts have no lines. Rows with equal ids and texts have equal lines, of which none is earlier; rows with
    equal ids and other texts are other documents. An empty table gives no rows.
    """
    lines = saved(_lines(docs, id_col, text_col), "lines", **_PLAIN)
    frequent = max(LEAST_FREQUENT, (lines.agg(F.sum("size")).first()[0] or 0) // SHARE)
    rarity = _rarity(lines, frequent)
    # Different sets of this similarity have a union of least 100 / (100 - percent) words.
    least = max(1, -(-100 // max(1, 100 - percent)) - 1)
    prefix = F.when(F.col("size") >= least, F.slice(_keys(F.col("words"), F.col("rarity")), 1, _prefix(F.col("size"), percent) + 1)).otherwise(F.array().cast("array<long>"))
    # The optimiser moves the one use of this column into its expression, so that no row carries the array.
    keyed = lines.withColumn("rarity", rarity.scalar()).select("a", "b", F.struct("rep", "n", "size", _parity(F.col("words")).alias("bits"), prefix.alias("prefix"), F.when(F.col("size") > WIDE, _wide_parity(F.col("words"))).alias("wide")).alias("own"))
    classes = saved(keyed.groupBy("a", "b").agg(F.min("own").alias("own"), F.count("*").alias("lines")).select("a", "b", "lines", "own.*"), "classes", **_DICTIONARY)

    ends = _ends(classes)
    groups = saved(ends.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > LED).select("key"), "groups")
    early = _confirmed(_with_earliest(ends, groups, percent), lines, percent)
    every, classes = classes, _still_open(classes.withColumn("open", F.lit(True)), early)

    entries = classes.select("n", "size", "bits", "open", F.posexplode("prefix").alias("at", "key")).where(F.col("at") < _prefix(F.col("size"), percent))
    # Lists can be long only where counts are high.
    high = LONG.bit_length() - 1 if frequent <= LONG else 0
    many = entries.where(F.col("key") >= high << HASH_BITS).groupBy("key").agg(F.count("*").alias("members"))
    long = saved(many.where(F.col("members") > LONG).select("key"), "long")
    whole = classes.agg(F.count("*"), F.sum(F.when(F.col("size") >= least, _prefix(F.col("size"), percent)))).first()
    apart, made, met = [early], [groups, long], []

    def meet(lists: DataFrame, shared: int) -> None:
        # Of each pair x is the smaller set, which needs fewer entries, or of equal ones the first.
        once = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.n") < F.col("y.n")))
        fit = once & _fit(percent, shared, ordered=True) & (F.col("x.open") | F.col("y.open"))
        met.append(saved(_meeting(lists.where(_smaller(percent, shared)), lists, fit).distinct(), "met"))

    some = not long.isEmpty()
    for part in _passes(entries, whole[1], whole[0]):
        meet(part.join(sent_if_small(long, SENT_KEYS), "key", "left_anti") if some else part, 1)
    if some:
        pair, rows = _two_words(classes, long, percent)
        longer = []
        for part in _passes(pair, rows, whole[0]):
            longer.append(saved(part.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > LONG).select("key"), "longer"))
            meet(part.join(sent_if_small(longer[-1], SENT_KEYS), "key", "left_anti"), 2)
        made += longer
        longer = reduce(DataFrame.unionByName, longer)
        if not longer.isEmpty():
            apart.append(_by_leaders(classes, pair.join(sent_if_small(longer, SENT_KEYS), "key", "left_semi"), lines, percent))
    made += met
    met = reduce(DataFrame.unionByName, met)
    direct = _confirmed_once(met, classes, lines, percent)
    gone = saved(reduce(DataFrame.unionByName, apart, direct).select("rep").distinct(), "gone")

    later = classes.select("a", "b", "lines", "rep").join(sent_if_small(gone, SENT_LINES).withColumn("gone", F.lit(True)), "rep", "left")
    later = saved(later.where("gone OR lines > 1").select("a", "b", "rep", F.coalesce("gone", F.lit(False)).alias("gone")), "later")
    own = lines.select(F.col("rep").alias("own"), "a", "b").join(sent_if_small(later, SENT_LINES), ["a", "b"])
    found = own.where(F.col("gone") | (F.col("own") > F.col("rep"))).select("own.*").distinct()
    found = saved(found, "found")
    drop_saved(lines, rarity, every, *made, gone, later)
    return found


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with the later matches cut from their texts; all columns stay and n_chars, if there is one, follows.

    Null and empty texts stay as they are. A document whose lines all go keeps an empty text. Repeated rows (equal
    ids and texts) all keep the same lines; rows with equal ids and other texts are documents of their own. An
    empty table stays empty. Columns may have any names.
    """
    found = matches_by_text(docs, id_col, text_col, percent)
    gone = found.groupBy("doc", "of").agg(F.collect_set("no").alias("lines"))
    if found.count() <= CUT_LINES:
        gone = F.broadcast(gone)  # so that texts stay where they are
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("of")).alias("docs")
    joined = whole.join(gone.alias("gone"), F.col("docs.doc").eqNullSafe(F.col("gone.doc")) & (F.col("docs.of") == F.col("gone.of")), "left").select("docs.row", "gone.lines")
    own = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda _, i: ~F.array_contains("lines", i)), "\n")
    text = F.when(F.col("lines").isNull(), own).otherwise(kept)
    out = joined.select("row", text.alias("text"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(v.alias(c) for c, v in columns.items()))
