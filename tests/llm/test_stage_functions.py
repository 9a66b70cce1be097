"""The functions behind the pipeline's stages on odd rows, clashing and dotted names, and empty tables."""

import pytest

from lodestar.llm import decontam, line_dedup, near_dedup, quality
from lodestar.llm.queries import QUALITY_MODELS

GOOD = "The bridge over the river was built by the people of this small town in a single dry summer, and it stood for two hundred years until the water rose above the road one night in March and took three arches away."
MORE = "Nobody in the valley could say who had drawn its plans, since the papers were lost in the fire of the old mill, but every child knew the song about the mason who would not sleep until the last stone was in its place."
PASSAGE = "what is the name of the longest river that flows through the capital of the country"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, GOOD, "en", "s", len(GOOD), "x"), (2, None, "en", "s", None, None), (3, "", None, None, 0, "y"), (4, "short", "zz", "s", 5, "y"), (5, f"{GOOD} {PASSAGE} {MORE}", "en", "s", 1, "z"), (6, PASSAGE, "en", "s", 1, "z"), (6, PASSAGE, "en", "s", 1, "z"), (None, GOOD, None, "s", 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string").selectExpr("*", "doc_id AS t", "text AS i", "lang AS c0", "source AS row", "n_chars AS lines")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("q1", PASSAGE), ("q2", None), ("q3", " , ")], "item_id string, text string")


def test_quality_rules_keep_all_columns(docs):
    got = quality.keep_good(docs, QUALITY_MODELS, {})
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r.doc_id for r in rows} == {1, 5, None} and all(r.i == r.text and r.c0 == r.lang for r in rows)


def test_decontamination_cuts_passages_and_drops_what_is_little_else(docs, items):
    """Coverage above half drops a document; below, the passage alone is cut, and n_chars follows."""
    got = decontam.clean(docs, items)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == [1, 2, 3, 4, 5, None]
    cut = next(r for r in rows if r.doc_id == 5)
    assert cut.text.split() == f"{GOOD} {MORE}".split() and cut.n_chars == len(cut.text) and cut["a.b"] == "z" and PASSAGE in cut.i
    assert sorted((r.doc_id for r in decontam.clean(docs, items, max_coverage=1.0).collect()), key=repr) == [1, 2, 3, 4, 5, 6, 6, None]
    assert decontam.clean(docs, items.where("false")).count() == docs.count()


def test_decontamination_by_several_blocks(spark, docs):
    """Blocks of few words give what one block does."""
    many = spark.createDataFrame([(f"q{i}", " ".join(GOOD.split()[i : i + 12])) for i in range(0, 24, 6)] + [("q", PASSAGE)], "item_id string, text string")
    one, several = (sorted(map(tuple, decontam.find(docs, many, block_words=n).collect()), key=repr) for n in (200_000, 20))
    assert one == several and any(r[5] for r in one)


def test_line_and_near_dedup_keep_all_columns(docs):
    lines = line_dedup.dedup(docs.where("doc_id IS NOT NULL"))
    assert lines.columns == docs.columns and lines.count() == 7
    kept = near_dedup.keep_first(docs.where("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 6]


def test_empty_tables_stay_empty(docs, items):
    none = docs.where("false")
    for got in (quality.keep_good(none, QUALITY_MODELS, {}), decontam.clean(none, items), near_dedup.keep_first(none), line_dedup.dedup(none)):
        assert got.columns == docs.columns and got.count() == 0
