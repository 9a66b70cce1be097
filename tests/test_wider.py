"""State, arrival, search, as-of slices, sketches, reach and n-grams against brute force, on odd rows and on plans."""

import datetime as dt
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import grams, graph, neighbours, sketches, temporal
from lodestar.plans import more, wider
from lodestar.sources import tables
from lodestar.streaming import attempts, windows

FOLDER = "/root/testdata/sf0.001"
STEPS = ("view", "click", "purchase")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("user_id < 40").withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_attempts(found, within):
    out, users = [], {}
    for user, event, ts, kind in found:
        if user is not None and event is not None and ts is not None and kind in STEPS:
            users.setdefault(user, []).append((ts, event, kind))
    for user, held in users.items():
        held.sort()
        for i, (ts, event, kind) in enumerate(held):
            if kind == STEPS[0]:
                reached = 1
                for later, _, k in held[i + 1 :]:
                    if reached < 3 and later <= ts + within and k == STEPS[reached]:
                        reached += 1
                out.append((user, event, ts, reached))
    return sorted(out, key=repr)


def test_attempts_of_a_table_match_brute_force(spark, events):
    within = timedelta(hours=12)
    found = [(r.user_id, r.event_id, r.ts, r.event_type) for r in events.collect()]
    assert rows(attempts.tabled(events, STEPS, within)) == brute_attempts(found, within)
    t = dt.datetime(2024, 1, 1)
    odd = [(1, 1, t, "view"), (1, 2, t, "click"), (1, 3, t + within, "purchase"), (2, 4, t, "view"), (2, 5, t + within + timedelta(microseconds=1), "click"), (None, 6, t, "view"), (3, None, t, "view"), (3, 7, None, "view"), (3, 8, t, None), (4, 9, t, "view"), (4, 9, t, "view")]
    frame = spark.createDataFrame(odd, "user_id long, event_id long, ts timestamp, event_type string")
    assert rows(attempts.tabled(frame, STEPS, within)) == brute_attempts(odd, within) != []
    assert rows(attempts.tabled(frame.where("false"), STEPS, within)) == []


@pytest.mark.parametrize("order", ["in order", "out of order"])
def test_streamed_attempts_equal_those_of_the_table(events, order):
    """Files out of order within the lateness change nothing; what the watermark has not passed is not out."""
    within, late = timedelta(hours=12), timedelta(minutes=10) if order == "in order" else timedelta(days=12)
    block = F.floor(F.datediff("ts", F.lit("1970-01-01")) / 5)
    arrival = block if order == "in order" else block * 10 + F.when(F.pmod(block, F.lit(3)) == 1, 25).otherwise(0)
    stream = attempts.streamed(tables.arriving(events, arrival), STEPS, within, f"{late // timedelta(minutes=1)} minutes")
    last = events.agg(F.max("ts")).first()[0]
    got, want = rows(windows.drained(stream, **attempts.STORE)), rows(attempts.tabled(events, STEPS, within))
    assert got == [w for w in want if w[2] + within < last - late] and len(got) > 100


def test_arrivals_are_read_in_order(spark, events):
    """Each batch is one file, in the order asked for, whatever the order of the rows."""
    seen = []
    stream = tables.arriving(events, -F.dayofmonth("ts") % 4)
    stream.writeStream.foreachBatch(lambda batch, n: seen.append({r[0] for r in batch.select(-F.dayofmonth("ts") % 4).distinct().collect()})).trigger(availableNow=True).start().awaitTermination()
    assert seen == [{-3}, {-2}, {-1}, {0}]


def test_late_files_lose_rows_and_only_theirs(spark):
    kept = {r.event_id for r in wider.stream_late(spark, "/root/testdata/sf0.01").collect()}
    every = {r.event_id: r.ts.date() for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").collect()}
    dropped = {((every[i] - dt.date(1970, 1, 1)).days // 5) % 3 for i in every.keys() - kept}
    assert dropped == {1} and len(kept) < len(every)


def brute_nearest(found, k):
    ids = [i for i, v in found if i is not None and v is not None and any(v)]
    m = np.array([v for i, v in found if i is not None and v is not None and any(v)], np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    out = []
    for a, q in enumerate(ids):
        order = sorted((-s[a, b], i) for b, i in enumerate(ids) if i != q)
        out += [(q, i, p + 1) for p, (_, i) in enumerate(order[:k])]
    return sorted(set(out), key=repr)


def test_nearest_of_all_on_clusters_copies_and_odd_rows(spark, monkeypatch):
    """Small blocks; a third of the rows is one vector; few rows; nulls and zeros."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    found = [(int(i), (centres[i % 6] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in rng.permutation(200)]
    found += [(1000 + i, [1.0] + [0.5] * 7) for i in range(100)] + [(None, [1.0] * 8), (5000, None), (5001, [0.0] * 8)]
    frame = spark.createDataFrame(found, "vec_id long, embedding array<float>")
    assert rows(neighbours.nearest_of_all(frame, 3)) == brute_nearest(found, 3)
    few = frame.where("vec_id IN (1, 2, 1000, 5000, 5001)")
    assert rows(neighbours.nearest_of_all(few, 5)) == brute_nearest([f for f in found if f[0] in (1, 2, 1000, 5000, 5001)], 5)
    assert rows(neighbours.nearest_of_all(frame.where("false"), 5)) == []


def test_bounds_rule_blocks_out(spark, monkeypatch):
    """Vectors in tight clusters need few tiles, and lose no neighbour by it."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    needs, meetings = [], neighbours.meetings
    monkeypatch.setattr(neighbours, "meetings", lambda made, k: needs.extend(len(r.needs) for r in made.select("needs").collect()) or meetings(made, k))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    found = [(i, (centres[i % 10] + 0.01 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    assert rows(neighbours.nearest_of_all(spark.createDataFrame(found, "vec_id long, embedding array<float>"), 5)) == brute_nearest(found, 5)
    assert len(needs) > 10 and sum(needs) < 0.5 * len(needs) ** 2


def test_sliced_asof_join_with_a_hot_key(spark):
    rng = np.random.default_rng(6)
    n = 3000
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 10 * 86_400, n), unit="s")
    frame = pd.DataFrame({"k": np.where(rng.random(n) < 0.9, 1, rng.integers(2, 9, n)), "ts": t, "v": rng.random(n), "no": np.arange(n), "right": rng.random(n) < 0.02})
    left, right = (spark.createDataFrame(frame[frame["right"] == side][["k", "ts", c]]) for side, c in ((False, "no"), (True, "v")))
    got = {r.no: r.v for r in temporal.asof_join_sliced(left, right, ["k"], "ts", ["v"], 3600).collect()}
    want = {}
    for r in frame[~frame["right"]].itertuples():
        met = frame[frame["right"] & (frame["k"] == r.k) & (frame["ts"] <= r.ts)]
        want[r.no] = max(zip(met["ts"], met["v"]))[1] if len(met) else None
    assert got == want and sum(v is None for v in want.values()) > 5
    plan = temporal.asof_join_sliced(left, right, ["k"], "ts", ["v"], 3600)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "__slice" in plan


def test_sliced_asof_join_on_odd_rows(spark):
    t = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (None, t, "b"), (1, None, "c"), (2, t, None), (3, t, "d")], "k long, ts timestamp, row string")
    right = spark.createDataFrame([(1, t, 5, None), (1, t, 4, 1), (1, t - timedelta(days=400), 9, 9), (None, t, 7, 7), (1, None, 8, 8), (3, t + timedelta(seconds=1), 1, 1), (2, t - timedelta(days=1), None, 3)], "k long, ts timestamp, v int, w int")
    got = rows(temporal.asof_join_sliced(left, right, ["k"], "ts", ["v", "w"], 60))
    assert got == sorted([(1, t, "a", 5, None), (1, t, "a", 5, None), (None, t, "b", None, None), (1, None, "c", None, None), (2, t, None, None, 3), (3, t, "d", None, None)], key=repr)
    assert rows(temporal.asof_join_sliced(left.where("false"), right, ["k"], "ts", ["v"], 60)) == []
    assert {r.v for r in temporal.asof_join_sliced(left, right.where("false"), ["k"], "ts", ["v"], 60).collect()} == {None}


def test_merged_sketches_are_as_close_as_one_sketch(spark):
    big = spark.range(400_000).select((F.col("id") % 30).alias("day"), F.xxhash64((F.col("id") * 7 % 150_000)).alias("item"), (F.col("id") * 7919 % 100_003).cast("double").alias("value"))
    stored = spark.createDataFrame(sketches.daily(big, F.col("day"), "item", "value").collect(), "day long, n long, items binary, quantiles binary")
    for r in sketches.merged(stored, F.floor(F.col("day") / 10), [0.1, 0.5, 0.99]).collect():
        part = big.where(F.floor(F.col("day") / 10) == r.span)
        exact = part.agg(F.count_distinct("item")).first()[0]
        assert abs(r["items"] - exact) <= 0.065 * exact and r.n == part.count()
        for q, x in zip((0.1, 0.5, 0.99), r.quantiles):
            assert abs(part.where(F.col("value") <= x).count() / r.n - q) <= 0.02


def test_a_join_prunes_the_partitioned_sink(spark):
    plan = wider.partitioned_sink(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_reach_ends_and_counts_fewest_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (3, 3), (4, 5), (1, 2), (None, 1), (3, None), (5, 6)], "src long, dst long")
    start = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    assert rows(graph.reachable(edges, start(1))) == [(1, 0), (2, 1), (3, 1)]
    assert rows(graph.reachable(edges, start(4, 2, None, 2))) == [(1, 2), (2, 0), (3, 1), (4, 0), (5, 1), (6, 2)]
    assert rows(graph.reachable(edges, start(9))) == [(9, 0)] and rows(graph.reachable(edges, start().where("false"))) == []
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    with pytest.raises(ValueError):
        graph.reachable(chain, start(0), max_rounds=4)


def test_grams_by_broadcast_and_by_salted_join(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, text), (2, text.upper() + " " + text), (3, None), (4, ""), (5, "a b c"), (6, f"x {text[4:]} y")], "doc_id long, text string")
    items = spark.createDataFrame([("p", text), ("q", "z " + text[2:]), ("r", None), ("s", "a b")], "item_id string, text string")
    want = sorted([(1, "p", 3), (2, "p", 3), (6, "p", 1), (1, "q", 2), (2, "q", 2), (6, "q", 1)], key=repr)
    for sent in (0, 1000):
        assert rows(grams.overlap(docs, items, "doc_id", "item_id", sent_grams=sent)) == want
    assert rows(grams.overlap(docs, items.where("false"), "doc_id", "item_id")) == []


def test_funnel_takes_the_earliest_times(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    found = [(1, t(1), "click"), (1, t(2), "view"), (1, t(2), "click"), (1, t(3), "purchase"), (2, t(1), "view"), (2, t(2), "click"), (2, t(2), "purchase"), (2, t(3), "purchase"), (3, t(1), "purchase"), (4, t(1), "other"), (5, None, "view")]
    frame = spark.createDataFrame(found, "user_id long, ts timestamp, event_type string")
    assert rows(temporal.funnel(frame, "user_id", "ts", "event_type", STEPS)) == [(1, 1), (2, 3), (3, 0), (5, 0)]


def test_not_in_keeps_rows_and_a_null_on_the_right_empties_it(spark):
    part = spark.createDataFrame([(1, 1), (2, None), (3, 10), (4, 5), (5, 4)], "p_partkey long, p_size int")
    nation = spark.createDataFrame([(0,), (1,), (2,)], "n_nationkey int")
    tables_of = lambda right: lambda name: {"part": part, "nation": right}[name]
    assert sorted(r.p_partkey for r in more.join_not_in(tables_of(nation)).collect()) == [4, 5]
    part.createOrReplaceTempView("not_in_part")
    with_null = spark.createDataFrame([(0,), (None,)], "n int")
    with_null.createOrReplaceTempView("not_in_right")
    assert spark.sql("SELECT p_partkey FROM not_in_part WHERE p_size NOT IN (SELECT n FROM not_in_right)").count() == 0



def test_token_jaccard_matches_brute_force(spark):
    """Prefixes of rare words lose no pair: random sets around the threshold, equal sets, empty and null texts."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in set(rng.zipf(1.4, rng.integers(1, 14)) % 40)) for _ in range(120)] + ["a b c", "a b c", "", None]
    found = [(f"q{i:03d}", x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame(found, "item_id string, text string")
    sets = [(i, set((x or "").split())) for i, x in found]
    want = sorted((a, b) for a, s in sets for b, t in sets if a < b and s & t and 10 * len(s & t) >= 3 * len(s | t))
    assert len(want) > 100 and rows(more.token_jaccard(lambda _: frame)) == sorted(want, key=repr)
