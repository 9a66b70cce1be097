"""Decontamination by several automata, and archives of pages whose digests repeat beyond what is sent."""

import pytest

from lodestar.llm import decontam, warc


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_each_block_is_built_once_and_all_give_what_one_gives(tables, monkeypatch):
    docs, items = tables
    one = sorted(map(tuple, decontam.find(docs, items).collect()))
    monkeypatch.setattr(decontam, "HELD_BYTES", 50_000)
    blocks = decontam.blocks_of(items, "item_id", "text", 10, block_words=300)
    assert len(blocks.numbers) > 3
    assert sorted(map(tuple, decontam.find(docs, items, block_words=300).collect())) == one and any(r[5] for r in one)


def test_items_that_are_null_wordless_or_repeated(spark, tables):
    docs, _ = tables
    odd = spark.createDataFrame([(None, "w1 w2"), ("a", None), ("b", ""), ("c", ", ."), ("d", "w1 w2"), ("d", "w1 w2")], "item_id string, text string")
    own = spark.createDataFrame([(1, "x W1, w2 y"), (2, "w2 w1"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.find(own, odd).collect()}
    assert got == {1: (4, 2, 2, True), 2: (2, 0, 0, False), 3: (0, 0, 0, False)}
    assert decontam.find(docs, odd.where("false")).where("contaminated OR n_hit > 0").count() == 0


@pytest.mark.parametrize("least", [0, 12])
def test_archives_by_join_and_by_sent_digests_agree(spark, monkeypatch, least):
    rows = [(i, f"http://h/{i}", "same long payload" if i % 3 else f"own {i % 7}" if i % 2 else None) for i in range(200)] + [(None, None, "same long payload"), (5, "again", "same long payload")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent = sorted(map(tuple, warc.round_trip(pages, least_bytes=least).collect()), key=repr)
    monkeypatch.setattr(warc, "SENT_DIGESTS", 0)
    assert sorted(map(tuple, warc.round_trip(pages, least_bytes=least).collect()), key=repr) == sent
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    count = {h: sum((x or "") == h for _, _, x in rows) for h in last}
    for (i, _, html) in rows:
        h = html or ""
        want = last[h] if count[h] > 1 and len(h) >= least and i != last[h] else None
        assert any(r[0] == i and r[1] == len(h) and r[4] == want for r in sent)


def test_tasks_hold_little_text_at_once():
    from lodestar.llm import near_dedup, packing, quality

    sizes = [decontam.Blocks("", [0], 10).batch_bytes, near_dedup.SLICE_BYTES, packing.SLICE_BYTES, quality.SLICE_BYTES]
    assert max(sizes) <= 2 << 20  # an executor holds two such workers beside its heap, see README
