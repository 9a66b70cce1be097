"""op1 where most lists are long: the same matches, few rows for each class, and groups of near copies."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup


@pytest.fixture(scope="module")
def many(spark):
    some = random.Random(3)
    common, rare = [f"c{k}" for k in range(60)], [f"r{k}" for k in range(3000)]
    lines = [[some.choice(common) for _ in range(14)] + some.sample(rare, 2) for _ in range(600)]
    near = [[w if some.random() > 0.04 else some.choice(common) for w in some.choice(lines)] for _ in range(300)]
    one = lines[0]
    near += [[*one[: k % 14], some.choice(rare), *one[k % 14 + 1 :]] for k in range(100)]
    texts = [" ".join(x) for x in lines + near]
    some.shuffle(texts)
    rows = [(k, "\n".join(texts[k : k + 5])) for k in range(0, len(texts), 5)]
    sets = [(k, no, frozenset(t.split())) for k, text in rows for no, t in enumerate(text.split("\n"))]
    want = {y[:2] for j, y in enumerate(sets) if any(100 * len(x[2] & y[2]) >= 80 * len(x[2] | y[2]) for x in sets[:j])}
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_long_lists_against_all_pairs_in_bounded_passes(many, monkeypatch):
    docs, want = many
    for name, value in (("LONG", 6), ("LEAST_FREQUENT", 4), ("AT_ONCE", 3), ("COUNTERS", 1 << 12), ("SENT_KEYS", 3), ("SENT_LINES", 5)):
        monkeypatch.setattr(line_dedup, name, value)
    names = []

    def saved(df, name, *args, own=line_dedup.saved, **options):
        out = own(df, name, *args, **options)
        names.append(name)
        assert name not in ("two_words", "own"), "two-word lists and sets were kept whole"
        return out

    monkeypatch.setattr(line_dedup, "saved", saved)
    assert {tuple(r) for r in line_dedup.matches(docs).collect()} == want
    assert names.count("met") > 2 and "members" in names


def test_rare_words_come_before_frequent_ones_however_many_share_a_counter(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COUNTERS", 1 << 10)
    rows = spark.range(2000).select(F.array(F.lit(7).cast("long"), F.xxhash64("id")).alias("words"))
    (row,) = line_dedup._rarity(rows, 32).collect()
    assert row.rarity[7] == 10 and sum(row.rarity) == 10


def test_group_of_near_copies_in_short_lists_does_not_make_all_its_pairs(spark, monkeypatch):
    base = [f"w{k}" for k in range(40)]
    copies = [[*base[: k % 40], f"other{k}", *base[k % 40 + 1 :]] for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(copies)], "doc_id long, text string").repartition(7)
    made = {}

    def saved(df, name, *args, own=line_dedup.saved, **options):
        out = own(df, name, *args, **options)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "saved", saved)
    assert {tuple(r) for r in line_dedup.matches(docs).collect()} == {(k, 0) for k in range(1, 400)}
    assert made["long"] == 0 and made["met"] + made["pairs"] + made["in_order"] < 10_000, made
