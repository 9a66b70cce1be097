"""op1's work a word and a line: what is done once a text, keys that sort as numbers, and lists whose smaller sets need fewer entries."""

import random

from pyspark.sql import functions as F

from lodestar.llm import line_dedup


def test_texts_are_hashed_and_split_once_and_not_once_a_line(spark):
    docs = spark.createDataFrame([(1, "a b\nc\td")], "doc_id long, text string")
    lines = line_dedup._lines(docs, "doc_id", "text")
    above, below = lines._jdf.queryExecution().optimizedPlan().toString().split("Generate ")
    assert "AS of#" in below and "AS of#" not in above
    assert "size(split" not in below and "Filter" not in below
    assert sorted((r.rep.no, r.size) for r in lines.collect()) == [(0, 2), (1, 2)]


def test_keys_cannot_be_null_and_are_sorted_by_rarity(spark):
    words = spark.range(1).select(F.array(*(F.lit(w).cast("long") for w in (3 << 21, (1 << 40) + 1, -5))).alias("words"), F.array_repeat(F.lit(0).cast("tinyint"), line_dedup.COUNTERS - 1).alias("zeros"))
    keyed = words.select(line_dedup._keys(F.col("words"), F.concat(F.array(F.lit(9).cast("tinyint")), "zeros")).alias("keys"))
    assert not keyed.schema["keys"].dataType.containsNull
    (row,) = keyed.collect()
    assert [k >> line_dedup.HASH_BITS for k in row["keys"]] == [0, 0, 9]


def test_smaller_sets_need_fewer_entries(spark):
    """A pair's first shared word lies at most as far as its least overlap lets it, in the smaller set and in the larger one."""
    for percent in (50, 80, 85):
        places = spark.range(1, 61).select(F.col("id").cast("int").alias("size")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
        kept = places.where(line_dedup._smaller(percent)).groupBy("size").agg(F.max("at")).collect()
        whole = {r[0]: r[1] for r in spark.range(1, 61).select("id", line_dedup._prefix(F.col("id"), percent)).collect()}
        for size, last in map(tuple, kept):
            # The larger set is of equal size at worst.
            overlap = min(o for o in range(size + 1) if 100 * o >= percent * (2 * size - o))
            assert last == size - overlap < whole[size]


def test_near_copies_in_small_and_large_groups(spark):
    some = random.Random(5)
    sets = []
    for group in (2, 3, 8, 9, 40):
        base = [f"g{group}w{k}" for k in range(20)]
        sets += [(base + [f"more{group}x{k}" for k in range(some.randrange(4))])[some.randrange(3) :] for _ in range(group)]
    some.shuffle(sets)
    want = {(j, 0) for j, y in enumerate(sets) if any(100 * len({*x} & {*y}) >= 80 * len({*x} | {*y}) for x in sets[:j])}
    docs = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(sets)], "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in line_dedup.matches(docs).collect()} == want
