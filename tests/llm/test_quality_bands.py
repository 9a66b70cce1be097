"""Quality rules against plain Python: counts, measures of both vocabularies, fitted bands, verdicts; held-out labels."""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import quality
from lodestar.llm.queries import BYTE_TOKENIZER, QUALITY_MODELS

WORD = re.compile(r"[^ \t-\r]+")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@cache
def vocabularies():
    return sentencepiece.SentencePieceProcessor(model_file=QUALITY_MODELS.pieces), Tokenizer.from_file(BYTE_TOKENIZER)


def plain(text):
    """Everything that a row of judge() holds but the verdict, by the plainest way."""
    text = text or ""
    words, at = WORD.findall(text), defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    pieces, by_byte = vocabularies()
    cut = {w: (pieces.encode(w), by_byte.encode(f" {w}", add_special_tokens=False).ids) for w in set(words)}
    first, second = ([i for w in words for i in cut[w][k]] for k in (0, 1))
    parts = {i for i in set(second) if "\ufffd" in by_byte.decode([i])}
    chars = sum(map(len, words))
    scripts = Counter(unicodedata.name(w[0]).split(" ")[0] for w in words if w[0].isalpha())
    entropy = -sum(c / len(first) * math.log2(c / len(first)) for c in Counter(first).values())
    return {
        "counts": (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)),
        "base_failed": len(words) < 20 or 100 * len(again) > 30 * len(words),
        "script": min(scripts, key=lambda s: (-scripts[s], s)) if scripts else "",
        "n_tokens": len(first),
        "measures": (chars / len(first), sum(map(pieces.is_byte, first)) / len(first), chars / len(second), sum(i in parts for i in second) / len(second), entropy) if first else (0.0,) * 5,
    }


def plain_verdict(row, lang, bands):
    band = bands.get(f"lang {lang}") or bands.get(f"script {row['script']}")
    if row["base_failed"] or not band:
        return not row["base_failed"]
    chars, share, chars_2, share_2, entropy = row["measures"]
    n = row["n_tokens"]
    least = band.at_one + band.per_doubling * math.log2(min(n, 2048)) - band.below - 3 / math.sqrt(n)
    return band.least_chars <= chars <= band.most_chars and share <= band.most_bytes and band.least_chars_2 <= chars_2 <= band.most_chars_2 and share_2 <= band.most_bytes_2 and entropy >= least


def same(r, want, lang, bands):
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want["counts"]
    assert (r.base_failed, r.script, r.n_tokens) == (want["base_failed"], want["script"], want["n_tokens"])
    assert np.allclose([r[m] for m in quality.MEASURES], want["measures"])
    assert r.kept == plain_verdict(want, lang, bands)


def test_rows_equal_plain_python(small):
    docs, labels = small
    bands = quality.fit(docs, labels, QUALITY_MODELS)
    assert {"lang en", "script LATIN"} <= set(bands)
    texts = {r.doc_id: (r.text, r.lang) for r in docs.where("doc_id % 4 = 1").collect()}
    rows = quality.judge(docs.where("doc_id % 4 = 1"), QUALITY_MODELS, bands).collect()
    assert len(rows) == len(texts) and any(not r.kept and not r.base_failed for r in rows)
    for r in rows:
        same(r, plain(texts[r.doc_id][0]), texts[r.doc_id][1], bands)


def test_scripts_and_odd_texts(spark, small):
    """Other scripts, ties of scripts, byte fallbacks, nulls, repeats and very long words and texts."""
    docs, labels = small
    bands = quality.fit(docs, labels, QUALITY_MODELS)
    russian = "\u0432 \u043d\u0430\u0447\u0430\u043b\u0435 \u0431\u044b\u043b\u043e \u0441\u043b\u043e\u0432\u043e "
    rows = [
        (1, russian * 3 + "\u0438 \u043c\u0438\u0440", None), (2, "abc \u0430\u0431\u0432 " * 2, "zz"), (3, "\U0001f9ff\U00012000 " * 30, "en"), (4, None, "en"), (5, "", None),
        (6, "x" * 300_000, "de"), (7, " ".join(f"word{i}" for i in range(60_000)), "en"), (7, " ".join(f"word{i}" for i in range(60_000)), "en"), (8, "a\u00a0b \u00a0c d\u3000 \u3000 e\u2003\u2003f \u00e9\u0301 x " * 4, "fr"), (None, "\u4e2d\u6587 " * 25, ""),
    ]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), QUALITY_MODELS, bands).collect()
    assert len(got) == len(rows)
    for r in got:
        text, lang = next((t, x) for i, t, x in rows if i == r.doc_id)
        same(r, plain(text), lang, bands)
    assert {r.doc_id: r.script for r in got}[None] == "CJK" and {r.doc_id: r.script for r in got}[2] == "CYRILLIC"


def test_bands_equal_plain_python(small):
    """fitted() by sorting and least squares of its own."""
    docs, labels = small
    clean = quality.judge(docs.join(labels.where("quality = 1"), "doc_id", "left_semi"), QUALITY_MODELS, {}).where("NOT base_failed AND script = 'LATIN'").collect()
    band = quality.fit(docs, labels, QUALITY_MODELS)["script LATIN"]

    def quantile(x, q):
        x = sorted(x)
        at = q * (len(x) - 1)
        low = x[int(at)]
        return low + (x[min(int(at) + 1, len(x) - 1)] - low) * (at - int(at))

    low, middle = (quantile([r.chars_per_token for r in clean], q) for q in (0.002, 0.5))
    slope, at_one = np.polyfit([math.log2(min(r.n_tokens, 2048)) for r in clean], [r.token_entropy for r in clean], 1)
    missed = [at_one + slope * math.log2(min(r.n_tokens, 2048)) - r.token_entropy - 3 / math.sqrt(r.n_tokens) for r in clean]
    assert np.allclose([band.least_chars, band.at_one, band.per_doubling, band.below], [low - (middle - low), at_one, slope, quantile(missed, 0.998)])


def test_no_labels_no_bands(small):
    docs, labels = small
    assert quality.fit(docs, labels.where("false"), QUALITY_MODELS) == {} == quality.fit(docs.where("false"), labels, QUALITY_MODELS)
    assert quality.fit(docs, labels.withColumn("quality", F.lit(None).cast("int")), QUALITY_MODELS) == {}


@pytest.mark.parametrize("lang", ["lang", "CAST(NULL AS string)"], ids=["by language", "by script"])
def test_held_out_labels(spark, lang):
    """Bands of one half of the labelled documents, judged on the other: clean ones stay, bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id", F.lit(7)) % 2 == 0
    bands = quality.fit(docs, labels.where(half), QUALITY_MODELS)
    rest = docs.withColumn("lang", F.expr(lang)).join(labels.where(~half), "doc_id", "left_semi")
    judged = quality.judge(rest, QUALITY_MODELS, bands).join(labels, "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    bad, lost = n.get((0, False), 0), n.get((1, False), 0)
    recall, precision = bad / (bad + n.get((0, True), 0)), bad / (bad + lost)
    print(n, recall, precision)
    assert recall >= 0.8 and precision >= 0.9 and lost <= 0.015 * n[1, True]
