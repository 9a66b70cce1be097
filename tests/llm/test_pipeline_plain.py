"""Each stage of the pipeline against plain Python, on what the stages before it kept."""

import re
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from lodestar.llm import quality
from lodestar.llm.queries import QUALITY_MODELS

sys.path.insert(0, str(Path(__file__).parent))
from test_quality_bands import plain, plain_verdict  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile("[ \t-\r]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return [w for w in SPACE.split(lowered(text)) if w]


def lines_dropped(texts):
    """Each text without its lines that match an earlier one (Jaccard of words 0.8), and without the texts left wordless."""
    seen, out = [], {}
    for i in sorted(texts):
        keep = []
        for line in texts[i].split("\n"):
            s = set(words(line))
            if not any(s and 100 * len(s & t) >= 80 * len(s | t) for t in seen):
                keep.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(keep)
    return {i: t for i, t in out.items() if words(t)}


def first_of_near(texts):
    """One text, of the smallest id, of each component of five-word shingle sets with a Jaccard of 0.8."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: t for i, t in texts.items() if group[i] == i}


def cleaned(texts, items):
    """Each text without words inside ten-word windows of items; texts with more than half of their words hit go."""
    windows = set()
    for item in items:
        w = TOKEN.findall(lowered(item or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} - {()}
    out = {}
    for i, text in texts.items():
        spans = [m.span() for m in TOKEN.finditer(text)]
        w = [lowered(text[a:b]) for a, b in spans]
        hit = set()
        for n in {len(x) for x in windows}:
            hit |= {k + j for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if 2 * len(hit) > len(w):
            continue
        pieces, begin = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                pieces.append(text[begin : spans[k][0]])
            begin = spans[k][1]
        out[i] = " ".join([*pieces, text[begin:]]).strip(" ") if hit else text
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, by id."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER).collect()
        assert len({r.doc_id for r in kept}) == len(kept)
        out[name] = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r.text for r in kept}
        docs = spark.createDataFrame(kept, schema)
    return out


def texts_of(rows):
    return {i: r.text or "" for i, r in rows.items()}


def test_quality_rules(spark, stages):
    given, kept = stages["quality_rules"]
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    bands = quality.fit(docs, labels, QUALITY_MODELS)
    assert kept == {i: r.text for i, r in given.items() if plain_verdict(plain(r.text), r.lang, bands)} and len(kept) < len(given)


def test_line_dedup(stages):
    given, kept = stages["line_dedup"]
    assert kept == lines_dropped(texts_of(given)) and kept != texts_of(given)


def test_near_dedup(stages):
    given, kept = stages["near_dedup"]
    assert kept == first_of_near(texts_of(given))


def test_near_dedup_alone(spark):
    """On the raw documents, where there are groups to reduce."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text RLIKE '[^ \t-\r]'")
    got = {r.doc_id: r.text for r in corpus_pipeline.near_dedup_stage(spark, docs, FOLDER).collect()}
    given = {r.doc_id: r.text for r in docs.collect()}
    assert got == first_of_near(given) and len(got) < len(given)


def test_decontamination(spark, stages):
    given, kept = stages["decontamination"]
    assert kept == cleaned(texts_of(given), [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])


def test_decontamination_alone(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, docs, FOLDER).collect()}
    given = {r.doc_id: r.text for r in docs.collect()}
    assert got == cleaned(given, [r.text for r in items.collect()]) and got != given
