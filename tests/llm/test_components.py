"""op5's components: a few tasks write the labels of a few edges, and labels are the same where they are shuffled."""

import random

import pytest

from lodestar.llm import near_dedup


@pytest.mark.parametrize("sent", [0, 300_000])
def test_components_of_few_edges_are_written_by_few_tasks(spark, monkeypatch, sent):
    monkeypatch.setattr(near_dedup, "SENT_ROWS", sent)
    some = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(a, a + some.randrange(1, 9)) for a in some.sample(range(1000, 3000), 300)] + [(9, 7), (7, 8), (5000, 1)]
    root = {x: x for pair in pairs for x in pair}
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    edges = spark.createDataFrame(pairs, "a long, b long")
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        labels = near_dedup.components(edges)
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert {r.node: r.component for r in labels.collect()} == root
    assert len(labels.inputFiles()) <= near_dedup.FEW or not sent
