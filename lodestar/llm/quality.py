"""Quality rules: repetition and symbol counts, and tokeniser fertility with rejection bands per language or script.

Two public vocabularies cut every word, one of pieces with byte fallback and one of bytes. The measures of a text
follow: characters per token and the share of tokens that are no whole character, of each vocabulary, and the entropy
of the token distribution of the first. Text of a language keeps within narrow bands of each; tables, shouting and
symbol noise fall out of them. Entropy rises with length, so its band is held against the entropy that texts of that
language have at that many tokens.

The bands are fitted on labelled clean documents, a sample of bounded size: one for each language that has enough of
them, and one for each script, which serves languages without a band of their own and unknown ones.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, as_array, give_back, hashes, mixed, numbered, slices, windows

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Words kept in a task's cache of token ids, and the longest that is kept; bytes of text measured at once.
CACHE_WORDS, CACHED_CHARS, SLICE_BYTES = 60_000, 64, 2 << 20
#: Words that the vocabularies cut at once.
BATCH_WORDS = 4096


class Vocabularies(NamedTuple):
    """Files of the two vocabularies, a sentencepiece model with byte fallback and byte-level ranks; the latter's pattern."""

    pieces: str
    bytes: str
    pattern: str


class Band(NamedTuple):
    """Limits for a language or script. Expected entropy (bits) is at_one + per_doubling * log2(tokens, at most 2048)."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_chars_2: float
    most_chars_2: float
    most_bytes_2: float
    at_one: float
    per_doubling: float
    below: float


#: Labelled clean documents that bands are fitted on at most, and the fewest of a language or script that give it a band.
SAMPLE, LEAST_CLEAN = 20_000, 30
#: Share of clean documents that may lie beyond each limit, and how far limits move out from there: by this part of the
#: way from the median for characters per token, by this much for shares of bytes.
TOLERANCE, MARGIN, BYTE_SLACK = 0.002, 1.0, 0.05
#: The entropy band widens by this over the root of the token count, as short texts scatter more.
SCATTER = 3.0

MEASURES = ("chars_per_token", "byte_share", "chars_per_token_2", "byte_share_2", "token_entropy")
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES)
)
_caches: dict[Vocabularies, tuple] = {}


def _is_part(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


def _vocabulary(models: Vocabularies):
    """Both models; which ids of each are no whole character, which of the second begin with a space; a cache of words."""
    if models not in _caches:
        import sentencepiece
        import tiktoken

        pieces = sentencepiece.SentencePieceProcessor(model_file=models.pieces)
        with open(models.bytes, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        by_byte = tiktoken.Encoding("bytes", pat_str=models.pattern, mergeable_ranks=ranks, special_tokens={})
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
        is_part, begins = np.zeros((2, max(ranks.values()) + 1), bool)
        for token, rank in ranks.items():
            is_part[rank], begins[rank] = _is_part(token), token.startswith(b" ")
        _caches[models] = (pieces, by_byte, is_byte, is_part, begins, {})
    return _caches[models]


def _byte_level(words: list[str], models: Vocabularies) -> tuple[list[int], list[int]]:
    """Of each word after a space: its tokens in the second vocabulary, and how many are parts of characters.

    Words are cut in one run, as no token crosses a space that only one precedes; words that hold white space of their
    own could change where a run is cut, so they go alone.
    """
    _, by_byte, _, is_part, begins, _ = _vocabulary(models)
    counts, parts = np.zeros((2, len(words)), np.int64)
    alone = [k for k, w in enumerate(words) if len(w.split()) != 1 or w[0].isspace() or w[-1].isspace()]
    for k in alone:
        ids = by_byte.encode_to_numpy(f" {words[k]}")
        counts[k], parts[k] = len(ids), is_part[ids].sum()
    rest = np.setdiff1d(np.arange(len(words)), alone)
    if len(rest):
        ids = by_byte.encode_to_numpy("".join(f" {words[k]}" for k in rest.tolist()))
        firsts = np.flatnonzero(begins[ids])
        counts[rest], parts[rest] = np.diff(np.append(firsts, len(ids))), np.add.reduceat(is_part[ids].astype(np.int64), firsts)
    return counts.tolist(), parts.tolist()


def _encoded(words: list[str], models: Vocabularies) -> list[tuple[bytes, int, int]]:
    """Of each word: its ids in the first vocabulary, and its tokens and parts of characters in the second."""
    pieces, *_, cache = _vocabulary(models)
    if len(cache) + len(words) > CACHE_WORDS:
        cache.clear()
    missing = [w for w in words if w and w not in cache]
    new = {"": (b"", 0, 0)}
    for begin in range(0, len(missing), BATCH_WORDS):
        some = missing[begin : begin + BATCH_WORDS]
        ids = (np.array(x, np.int32).tobytes() for x in pieces.encode(some, num_threads=1))
        new.update(zip(some, zip(ids, *_byte_level(some, models), strict=True), strict=True))
    cache.update((w, found) for w, found in new.items() if len(w) <= CACHED_CHARS)
    return [new[w] if w in new else cache[w] for w in words]


def _forget() -> None:
    """Empty the caches and give back unused memory: a worker goes on to tasks of other operators."""
    for *_, cache in _caches.values():
        cache.clear()
    give_back()


def repeated(hashed: np.ndarray, n: int = WINDOW) -> int:
    """How many words stand in n-word windows that occur twice or more."""
    h = windows(hashed, n)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(hashed) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def fertility(ids: np.ndarray, chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share and token entropy in bits; zeros for no tokens."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return chars / len(ids), float(is_byte[ids].mean()), float(-(p * np.log2(p)).sum())


@lru_cache(4096)
def script_of(char: str) -> str:
    """The script of a letter, as its Unicode name begins; empty for anything else."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def within(band: Band | None, n: int, chars: float, byte_share: float, chars_2: float, byte_share_2: float, entropy: float) -> bool:
    """The band's verdict on the measures of a text of n tokens; no band rejects nothing."""
    if band is None:
        return True
    expected = band.at_one + band.per_doubling * np.log2(min(max(n, 1), 2048))
    first = band.least_chars <= chars <= band.most_chars and byte_share <= band.most_bytes
    second = band.least_chars_2 <= chars_2 <= band.most_chars_2 and byte_share_2 <= band.most_bytes_2
    return bool(first and second and entropy >= expected - band.below - SCATTER / max(n, 1) ** 0.5)


def fitted(n: np.ndarray, measures: np.ndarray, tolerance: float = TOLERANCE) -> Band:
    """The band of clean texts with these token counts and MEASURES (a column each)."""
    chars, share, chars_2, share_2, entropy = measures.T

    def limits(x: np.ndarray) -> tuple[float, float]:
        low, middle, high = np.quantile(x, [tolerance, 0.5, 1 - tolerance])
        return low - MARGIN * (middle - low), high + MARGIN * (high - middle)

    doublings = np.log2(np.clip(n, 1, 2048))
    spread = doublings - doublings.mean()
    slope = float(spread @ entropy / (spread @ spread)) if spread.any() else 0.0
    at_one = float(entropy.mean() - slope * doublings.mean())
    missed = at_one + slope * doublings - entropy - SCATTER / np.sqrt(np.maximum(n, 1))
    most = [float(np.quantile(x, 1 - tolerance)) + BYTE_SLACK for x in (share, share_2)]
    return Band(*map(float, limits(chars)), most[0], *map(float, limits(chars_2)), most[1], at_one, slope, float(np.quantile(missed, 1 - tolerance)))


def fit(
    docs: DataFrame, labels: DataFrame, models: Vocabularies, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quality_col: str = "quality", sample: int = SAMPLE, least: int = LEAST_CLEAN, tolerance: float = TOLERANCE,
) -> dict[str, Band]:
    """Bands by "lang ..." and "script ..." from documents that labels call clean (quality 1) and the base rules pass.

    The sample is the `sample` ids of least hash, and as many documents at most, so it is the same in every run. Null
    ids and labels are no labels; a null or empty language counts for its script alone; without labels there are no bands.
    """
    chosen = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("i")).where("i IS NOT NULL").distinct().orderBy(F.xxhash64("i"), "i").limit(sample)
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # At most `sample` ids travel to the tasks.
    own = own.join(F.broadcast(chosen), "i", "left_semi")
    clean = _judged(own, models, {}, "i", "text", "lang").where("NOT base_failed")
    clean = clean.select("lang", "script", "n_tokens", *MEASURES).orderBy(F.xxhash64("doc_id"), "n_tokens", *MEASURES, "lang").limit(sample).toPandas()
    bands = {}
    for kind in ("lang", "script"):
        for name, some in clean[clean[kind].fillna("") != ""].groupby(kind):
            if len(some) >= least:
                bands[f"{kind} {name}"] = fitted(some["n_tokens"].to_numpy(), some[list(MEASURES)].to_numpy(float), tolerance)
    return bands


def band_of(bands: dict[str, Band], lang: str | None, script: str) -> Band | None:
    """The band of the language, or else of the script."""
    return bands.get(f"lang {lang}", bands.get(f"script {script}"))


def _measured(texts: pa.Array, langs: list[str | None], models: Vocabularies, bands: dict[str, Band]) -> list[list]:
    """The columns of FIELDS for a batch."""
    words = Words(texts)
    vocabulary = words.vocabulary.to_pylist()
    hashed = mixed(hashes(words.vocabulary))
    encoded, counts, parts = zip(*_encoded(vocabulary, models), strict=True) if vocabulary else ((), (), ())
    lengths, tokens, parts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4, np.array(counts, np.int64), np.array(parts, np.int64)
    letters = pc.utf8_slice_codeunits(words.vocabulary, 0, 1).dictionary_encode()
    scripts, own = np.unique(np.array([script_of(c) for c in letters.dictionary.to_pylist()], str), return_inverse=True)
    script_codes = own[letters.indices.to_numpy(zero_copy_only=False)]
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    pool = np.frombuffer(b"".join(encoded), np.int32)
    in_word = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    is_byte = _vocabulary(models)[2]
    symbols = pc.count_substring_regex(texts, f"[{SYMBOLS}]").to_pylist()
    out = []
    for i, text in enumerate(texts.to_pylist()):
        codes = words.row(i)
        n, chars, again = len(codes), int(in_word[codes].sum()), repeated(hashed[codes])
        count = lengths[codes]
        ends = np.cumsum(count)
        ids = pool[np.repeat(firsts[codes] - ends + count, count) + np.arange(ends[-1] if n else 0)]
        per_token, byte_share, entropy = fertility(ids, chars, is_byte)
        total = int(tokens[codes].sum())
        measures = (per_token, byte_share, chars / total if total else 0.0, int(parts[codes].sum()) / total if total else 0.0, entropy)
        votes = np.bincount(script_codes[codes], minlength=len(scripts)) * (scripts != "") if n else np.zeros(1, int)
        script = str(scripts[votes.argmax()]) if votes.any() else ""
        failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
        kept = not failed and within(band_of(bands, langs[i], script), len(ids), *measures)
        out.append((n, chars, symbols[i], repeated_lines(text), again, failed, kept, script, len(ids), *measures))
    return list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)


_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64()] + [pa.float64()] * len(MEASURES)


def _judged(docs: DataFrame, models: Vocabularies, bands: dict[str, Band], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang and the columns of FIELDS."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    names = ["doc_id", "lang", *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                columns = _measured(as_array(batch.column("t")), batch.column("lang").to_pylist(), models, bands)
                arrays = (pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *arrays], names=names)
        _forget()

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang string, {FIELDS}")


def judge(docs: DataFrame, models: Vocabularies, bands: dict[str, Band], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with its counts, measures and verdict by bands that fit() made, in one pass without a shuffle.

    A null or empty text has no words, zero measures and fails; repeated rows are judged each; other columns
    are not read; an unknown or null language has its script's band, and a script without one is judged by the base
    rules alone.
    """
    return _judged(docs, models, bands, id_col, text_col, lang_col).drop("lang")


def keep_good(docs: DataFrame, models: Vocabularies, bands: dict[str, Band], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns, under any names; rows are judged where they lie.

    Null and empty texts go, as they have no words; a null language is an unknown one; repeated rows are judged
    each; an empty table stays empty.
    """

    own, (text, lang) = numbered(docs), (f"c{docs.columns.index(c)}" for c in (text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, SLICE_BYTES):
                kept = _measured(as_array(batch.column(text)), batch.column(lang).to_pylist(), models, bands)[6]
                yield batch.filter(pa.array(kept, pa.bool_()))
        _forget()

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
