"""Which nodes of a graph can be reached, in how many steps, by growing a frontier to its fixpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import work_folder

#: Rounds after which growing ends with an error: the longest shortest path that is looked for.
MAX_ROUNDS = 200


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, hops): the nodes reached from starts (node) over edges (src, dst), with the fewest steps.

    Each round joins the nodes new in the last one with the edges, drops those known and writes what is new to the
    shared folder, so the plan of a round does not grow and a lost executor costs its tasks alone. Null ends lead
    nowhere, repeated edges and loops change nothing; no start gives no rows.
    """
    spark, folder = edges.sparkSession, f"{work_folder(edges.sparkSession)}/reach-{uuid.uuid4().hex}"
    kind = edges.schema["src"].dataType.simpleString()
    edges.dropna().distinct().write.parquet(f"{folder}/edges")
    edges = spark.read.schema(edges.select("src", "dst").schema).parquet(f"{folder}/edges")

    def put(nodes: DataFrame, hops: int) -> DataFrame:
        nodes.select(F.col("node").cast(kind), F.lit(hops).alias("hops")).write.parquet(f"{folder}/hops-{hops}")
        return spark.read.schema(f"node {kind}, hops int").parquet(f"{folder}/hops-{hops}")

    known = new = put(starts.select("node").dropna().distinct(), 0)
    hops = 0
    while not new.isEmpty():
        if hops == max_rounds:
            raise ValueError(f"more than {max_rounds} rounds")
        hops += 1
        new = put(edges.join(new, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti"), hops)
        known = spark.read.schema(f"node {kind}, hops int").parquet(*(f"{folder}/hops-{h}" for h in range(hops + 1)))
    return known
