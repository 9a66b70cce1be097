"""Secret scanning: listed patterns, and a battery of randomness tests under false-discovery control.

Long runs of code characters are candidates. Each gets the encoding its characters fit (hex, letters of one case,
base32, base36, base64). Under that encoding's uniform distribution, a chi-squared test of its symbols, a runs test
about the middle of the alphabet and a lag-1 serial correlation each give a standard score; the sum of their squares
must keep below a quantile of the chi-squared distribution of three degrees. Text that is written changes character
class rarely and prefers some letters; the likelihood ratio of the candidate's changes and letters, random against
written, bounds its p-value against being written (by Markov's inequality) and sharpens with length. Within strata
of length, the Benjamini-Hochberg rule over these p-values of all candidates of all documents, counted in a histogram
of bounded size, sets how large a ratio must be.

Everything is DataFrame expressions. Positions come from the lengths of matches and of the text between them.
Spark computes what a lambda names for each element again, so all that is costly is bound to a variable before.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

# The listed patterns; the shortest match (of the value, for assign) that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 8
#: Any match of ASSIGN with such a value has this, which is far quicker to look for: the end of a name, the sign, the value.
SIGN = r"""[:=](?<=[dDtTnNyY"'\x20][:=])\x20*["']?[A-Za-z0-9+/_.=-]{%d}""" % LEAST_VALUE
#: Runs are maximal here, so a least length in the pattern finds the runs that a later test of length would keep.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")
#: The kind of the spans that the tests add.
RANDOM = "random"
#: Characters are listed, as Java tests a list in one step but each range by itself.
CANDIDATE = f"[{string.ascii_letters}{string.digits}+/_-]{{20,}}={{0,2}}"
#: (pattern, alphabet, shares of lower case, upper case, digits, others) of the encodings, first fit first.
ENCODINGS = (
    ("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", (6 / 16, 0, 10 / 16, 0)),
    ("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", (0, 6 / 16, 10 / 16, 0)),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", (1, 0, 0, 0)),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", (0, 1, 0, 0)),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0, 26 / 32, 6 / 32, 0)),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", (26 / 36, 0, 10 / 36, 0)),
    ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (0, 26 / 36, 10 / 36, 0)),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26 / 64, 26 / 64, 10 / 64, 2 / 64)),
)
#: What the squared scores of the three tests may sum to (one random string in a thousand has more).
ACCEPTED = 16.27
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Share of neighbours in written words that differ in character class.
WRITTEN_CHANGES = 0.12
# Letters of English text in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
#: Letters rarer than this (in percent) count as this common, as names and other languages use them more.
LEAST_LETTER = 0.5
#: Share of false discoveries among those of a length stratum.
FALSE_SHARE = 0.01
#: Steps of a factor of ten in the histogram of p-values, and its last bin.
BINS, LAST_BIN = 10, 400


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _powers(size: Column) -> Column:
    """The powers of two 1, 2, 4, ..., the last not below size."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.log2(size + 1.0)).cast("int")), lambda e: F.pow(F.lit(2.0), e).cast("int"))


def _sums(lengths: Column) -> Column:
    """Of an array of lengths, the sum up to each: in step s every place adds what lies s before it."""
    zero = F.lit(0).cast("long")
    return _bound(lengths, lambda all_: F.aggregate(_powers(F.size(all_)), all_, lambda sums, s: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - s), zero))))


def _below(ordered: Column, steps: Column, bound: Column) -> Column:
    """How many numbers of an ascending array are less than bound; steps: powers of two, descending from its size."""
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(ordered, n + s - 1) < bound, n + s).otherwise(n))


def _spans(text: Column, pattern: str, given: Column) -> Column:
    """Array of (start, end, found) of the leftmost non-overlapping matches, in code points; empty without a match.

    given must hold for texts with a match that counts; the others are not searched.
    """

    def placed(found: Column) -> Column:
        between = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")), 1, F.size(found))
        ends = _sums(F.zip_with(between, found, lambda b, x: b + F.length(x)))
        return F.zip_with(ends, found, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("found")))

    spans = _bound(F.regexp_extract_all(text, F.lit(pattern), 0), placed)
    return F.when(given & text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that no other overlaps: as many others end before each as start before its end."""

    def kept(all_: Column) -> Column:
        below = lambda name, bound: _below(all_[name], all_["steps"], bound)
        return F.filter(spans, lambda s: below("starts", s["end"]) == below("ends", s["start"] + 1))

    starts, ends = F.array_sort(F.transform(others, lambda o: o["start"])), F.array_sort(F.transform(others, lambda o: o["end"]))
    return _bound(F.struct(starts.alias("starts"), ends.alias("ends"), F.reverse(_powers(F.size(others))).alias("steps")), kept)


def _kind(spans: Column, kind: int | str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _by_encoding(code: Column, value) -> Column:
    """value(alphabet, shares) of the first encoding whose pattern fits code."""
    out = F.lit(value(*ENCODINGS[-1][1:]))
    for pattern, alphabet, shares in reversed(ENCODINGS[:-1]):
        out = F.when(code.rlike(pattern), F.lit(value(alphabet, shares))).otherwise(out)
    return out


def _change_ratios(shares: tuple) -> tuple[float, float]:
    """log10 likelihood ratio, random against written, of a change of class between neighbours and of none."""
    often = 1 - sum(x * x for x in shares)
    return (math.log10(often / WRITTEN_CHANGES), math.log10((1 - often) / (1 - WRITTEN_CHANGES))) if often else (0.0, 0.0)


def _letter_ratios(alphabet: str) -> list[float]:
    """log10 likelihood ratio, random against written, of each letter a to z; 0 where the alphabet lacks it."""
    own = set(alphabet.lower())
    written = [max(x, LEAST_LETTER) for x in LETTERS]
    letters = len(own & set(_LOWER))
    return [math.log10(sum(written) / x / letters) if c in own else 0.0 for c, x in zip(_LOWER, written, strict=True)]


def _scored(code: Column, alphabet: Column, values: Column, steps: Column) -> tuple[Column, Column]:
    """(evidence, random) of a code: its symbols' places in its alphabet, from the middle, and the products of neighbours."""
    n, k = F.length(code).cast("double"), F.length(alphabet).cast("double")
    zero = F.lit(0.0)
    add = lambda a, x: a + x
    squares = F.aggregate(F.array_distinct(F.split(code, "")), zero, lambda a, c: a + F.pow(n - F.length(F.replace(code, c, F.lit(""))), F.lit(2.0)))
    uniform = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    # Every alphabet has an even number of symbols, so half of all neighbours lie on both sides of its middle.
    crossings = F.aggregate(steps, zero, lambda a, x: a + F.when(x < 0, 1.0).otherwise(0.0))
    runs = (2 * crossings - (n - 1)) / F.sqrt(n - 1)
    serial = F.aggregate(steps, zero, add) / F.aggregate(F.transform(values, lambda v: v * v), F.lit(1e-9), add) * F.sqrt(n - 1)
    battery = _bound(uniform, lambda x: x * x) + _bound(runs, lambda x: x * x) + _bound(serial, lambda x: x * x)
    changes = F.length(F.regexp_replace(code, "[a-z]+|[A-Z]+|[0-9]+|[+/]+", "x")).cast("double") - 1
    changed, same = (_by_encoding(code, lambda _, s, i=i: _change_ratios(s)[i]) for i in (0, 1))
    places = F.transform(F.filter(F.split(F.lower(code), ""), lambda c: F.instr(F.lit(_LOWER), c) > 0), lambda c: F.instr(F.lit(_LOWER), c) - 1)
    letters = _bound(_by_encoding(code, lambda a, _: _letter_ratios(a)), lambda ratios: F.aggregate(places, zero, lambda a, i: a + F.get(ratios, i)))
    evidence = F.greatest(_bound(changes, lambda c: c * changed + (n - 1 - c) * same) + letters, zero)
    return evidence, battery < ACCEPTED


def _tested(span: Column) -> Column:
    """Struct (start, end, length, evidence, random) of a candidate: evidence is at most -log10 p against written text."""

    def result(code: Column, *parts: Column) -> Column:
        evidence, random = _scored(code, *parts)
        n = F.length(code).cast("int")
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), n.alias("length"), evidence.alias("evidence"), random.alias("random"))

    def placed(code: Column, alphabet: Column) -> Column:
        middle = (F.length(alphabet).cast("double") + 1) / 2
        values = F.transform(F.split(code, ""), lambda c: F.instr(alphabet, c) - middle)
        steps = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: a * b)
        return _bound(values, lambda v: _bound(steps(v), lambda s: result(code, alphabet, v, s)))

    code = F.translate(F.rtrim(span["found"], F.lit("=")), "-_", "+/")
    return _bound(code, lambda c: _bound(_by_encoding(c, lambda a, _: a), lambda a: placed(c, a)))


def _stratum(length: Column) -> Column:
    """Strata of lengths: half octaves."""
    return F.floor(2 * F.log2(length.cast("double"))).cast("int")


def _bin(evidence: Column) -> Column:
    return F.least(F.floor(evidence * BINS), F.lit(LAST_BIN)).cast("int")


def _thresholds(tested: DataFrame, share: float) -> DataFrame:
    """(stratum, bin): the least bin of evidence that keeps false discoveries to share, by Benjamini and Hochberg."""
    each = tested.select(F.explode("candidates").alias("c")).select(_stratum(F.col("c.length")).alias("stratum"), _bin(F.col("c.evidence")).alias("bin"))
    counts = each.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    # At most a few dozen strata of LAST_BIN + 1 bins.
    listed = counts.groupBy("stratum").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    above = F.transform("bins", lambda b: F.struct(b["bin"].alias("bin"), F.aggregate(F.filter("bins", lambda x: x["bin"] >= b["bin"]), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))
    kept = F.filter(above, lambda b: F.col("all") * F.pow(F.lit(10.0), -b["bin"].cast("double") / BINS) <= share * b["n"])
    return listed.select("stratum", F.array_min(F.transform(kept, lambda b: b["bin"])).alias("bin")).where("bin IS NOT NULL")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    A null text counts as empty and has no spans; repeated rows are scanned each and count as candidates each;
    an empty table gives no rows; other columns are not read. Added spans touch no span of the listed patterns.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Codes in hex are runs too, so one search clears most texts of both.
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text.rlike(CANDIDATE).alias("runs"))
    text, some = F.col("text"), F.col("runs")
    assigned = F.filter(_spans(text, ASSIGN, text.rlike(SIGN)), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 1)) >= LEAST_VALUE)
    base = F.concat(_kind(assigned, "assign", 0), _kind(_spans(text, ACCESS, F.lit(True)), "access", 1), _kind(_spans(text, HEX, some), "hex", 2))
    found = texts.select("doc_id", base.alias("base"), _spans(text, CANDIDATE, some).alias("runs"))
    tested = saved(found.select("doc_id", F.array_sort("base").alias("base"), F.transform(_apart(F.col("runs"), F.col("base")), _tested).alias("candidates")), "tested")

    least = _thresholds(tested, false_share).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin")))).scalar()
    strong = F.filter("candidates", lambda c: c["random"] & F.coalesce(_bin(c["evidence"]) >= F.try_element_at(F.col("least"), _stratum(c["length"])), F.lit(False)))
    out = tested.withColumn("least", least).select("doc_id", "base", _kind(strong, RANDOM, 3).alias("added"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )
