"""The nearest vectors of every vector by cosine, exactly, over an inverted file of cells.

Pivots are a sample of at most PIVOTS distinct vectors; every vector lies in the cell of its nearest pivot, and near
cells together make a tile, in blocks of bounded size. A block first meets itself, which bounds the distance of each of
its vectors' k-th neighbour; then it meets every other block but those that the triangle inequality rules out: of whose
cells every one has its pivot farther from every vector than the vector's bound and the cell's radius together. So
results are those of the full product, and only the work depends on the sample.

Equal vectors are one throughout, with the smallest ids of their group, so a group of copies makes no pairs. A meeting
of two blocks is one product of matrices.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import work_folder

#: Pivots at most, whatever the table's size, and vectors in a block, about, as hashes deal them.
PIVOTS, BLOCK = 4096, 8192
#: Decimals to which similarities are told apart; equal ones go by id.
DECIMALS = 9
#: Room for rounding in bounds on distances and similarities.
SLACK = 1e-6
#: Blocks that a block meets in one task.
TOGETHER = 16
#: Rows of a product at once.
_ROWS = 256


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as rows of length one."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * vectors @ pivots.T, 0))


def distinct_vectors(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(rep, ids, vector): each different vector with the k + 1 smallest ids that have it; null and zero vectors have no direction and are left out."""
    own = vectors.where(F.col(id_col).isNotNull() & F.exists(F.col(vector_col), lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    return first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "ids", "vector")


def in_cells(distinct: DataFrame, pivots: np.ndarray) -> DataFrame:
    """distinct plus its cell and the distance to the cell's pivot."""
    sent = distinct.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_unit(batch.column("vector")), sent.value)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "away"])

    kind = distinct.schema["rep"].dataType.simpleString()
    return distinct.select("rep", "ids", "vector").mapInArrow(run, f"rep {kind}, ids array<{kind}>, vector {distinct.schema['vector'].dataType.simpleString()}, cell int, away double")


def product_best(queries: np.ndarray, vectors: np.ndarray, n: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each query's n best of vectors that reach its least score; vectors are in order of their ids."""
    rows, cols, scores = [], [], []
    for at in range(0, len(queries), _ROWS):
        s = queries[at : at + _ROWS] @ vectors.T
        bound = least[at : at + _ROWS] - SLACK
        if np.isneginf(bound).any() and s.shape[1] > n:
            bound = np.maximum(bound, -np.partition(-s, n - 1, axis=1)[:, n - 1] - SLACK)
        row, col = np.nonzero(s >= bound[:, None])
        score = np.round(s[row, col], DECIMALS)
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < n
        rows.append(row[first] + at), cols.append(col[first]), scores.append(score[first])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _found(reps: pa.Array, ids: pa.Array, row: np.ndarray, col: np.ndarray, score: np.ndarray) -> dict[str, pa.Array]:
    """A row for each id of each vector found."""
    lists = ids.take(pa.array(col))
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return {"query": reps.take(pa.array(np.repeat(row, n))), "id": lists.flatten(), "score": pa.array(np.repeat(score, n))}


def _one(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def blocks(members: DataFrame, k: int, pivots: np.ndarray, radius: np.ndarray, tiles: np.ndarray, parts: dict[int, int]) -> DataFrame:
    """A row for each block: its vectors with their ids and bounds, the tiles that it needs, and what it found in itself."""
    kind, n = members.schema["rep"].dataType.simpleString(), k + 1
    sent = members.sparkSession.sparkContext.broadcast((pivots, radius, tiles))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        pivots, radius, tiles = sent.value
        vectors, reps, ids = _unit(_one(table, "vector")), _one(table, "rep"), _one(table, "ids")
        row, col, score = product_best(vectors, vectors, n, np.full(len(vectors), -np.inf))
        copies = pc.list_value_length(ids).to_numpy(zero_copy_only=False)[col]
        # The score at which a vector has n ids, or none if it has fewer yet.
        enough = np.cumsum(copies) - np.concatenate([[0], np.cumsum(copies)])[np.searchsorted(row, row)] >= n
        least = np.full(len(vectors), -np.inf)
        at = np.flatnonzero(enough)[::-1]
        least[row[at]] = score[at]
        needed = np.zeros(int(tiles.max()) + 1, bool)
        for start in range(0, len(vectors), _ROWS):
            far = _distances(vectors[start : start + _ROWS], pivots)
            bound = np.sqrt(np.maximum(2 - 2 * np.maximum(least[start : start + _ROWS], -2), 0)) + SLACK
            needed[tiles[((far - radius <= bound[:, None]) & (radius >= 0)).any(axis=0)]] = True
        found = _found(reps, ids, row, col, score)
        one = lambda x: pa.array([x.to_pylist() if isinstance(x, pa.Array) else x.tolist()])
        named = {"tile": table.column("tile")[:1], "part": table.column("part")[:1], "reps": one(reps), "ids": one(ids), "vectors": pa.array([vectors.tobytes()], pa.binary()), "least": one(least), "needs": pa.array([np.flatnonzero(needed).tolist()], pa.list_(pa.int32()))}
        return pa.table(named | {c: one(x) for c, x in found.items()})

    schema = f"tile int, part int, reps array<{kind}>, ids array<array<{kind}>>, vectors binary, least array<double>, needs array<int>, query array<{kind}>, id array<{kind}>, score array<double>"
    tile_of = F.array(*(F.lit(int(t)) for t in tiles))[F.col("cell")]
    many = F.array(*(F.lit(parts.get(t, 1)) for t in range(int(tiles.max()) + 1)))
    dealt = members.withColumn("tile", tile_of).withColumn("part", F.pmod(F.xxhash64("rep"), many[F.col("tile")]).cast("int"))
    return dealt.groupBy("tile", "part").applyInArrow(run, schema)


def meetings(made: DataFrame, k: int) -> DataFrame:
    """(query, id, score): what each block finds in the other blocks of the tiles that it needs, TOGETHER blocks a task; each one met raises the bounds for the next."""
    kind, n = made.schema["reps"].dataType.elementType.simpleString(), k + 1
    name = F.concat_ws("/", "tile", "part")
    groups = max(1, -(-made.count() // TOGETHER))
    pairs = made.select(name.alias("a"), F.explode("needs").alias("tile")).join(made.select("tile", name.alias("b")), "tile").where("a <> b")
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(groups)).alias("g"))
    named = made.select(name.alias("name"), "reps", "ids", "vectors", "least")
    asks = pairs.select("a", "g").distinct().join(named, F.col("a") == F.col("name")).withColumn("asks", F.lit(True))
    has = pairs.join(named, F.col("b") == F.col("name")).withColumn("asks", F.lit(False))
    columns = ["a", "g", "asks", "reps", "ids", "vectors", "least"]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(range(len(table)), key=lambda i: not table.column("asks")[i].as_py())
        reps, ids = (lambda i: table.column("reps")[i].values), (lambda i: table.column("ids")[i].values)
        matrix = lambda i: np.frombuffer(table.column("vectors")[i].as_buffer()).reshape(len(reps(i)), -1)
        query, least = matrix(rows[0]), table.column("least")[rows[0]].values.to_numpy().copy()
        row, found, score = np.empty(0, np.int64), [], np.empty(0)
        for i in rows[1:]:
            r, c, s = product_best(query, matrix(i), n, least)
            lists = ids(i).take(pa.array(c))
            many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row, score = np.concatenate([row, np.repeat(r, many)]), np.concatenate([score, np.repeat(s, many)])
            found = pa.concat_arrays([found, lists.flatten()]) if len(found) else lists.flatten()
            order = np.lexsort((np.argsort(np.argsort(found.to_numpy(zero_copy_only=False), kind="stable")), -score, row))
            row, score = row[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, score, found = row[place < n], score[place < n], found.take(pa.array(order[place < n]))
            least[row[place[place < n] == n - 1]] = np.maximum(least[row[place[place < n] == n - 1]], score[place[place < n] == n - 1])
        return pa.table({"query": reps(rows[0]).take(pa.array(row)), "id": found if len(found) else reps(rows[0])[:0], "score": pa.array(score)})

    return asks.select(columns).unionByName(has.select(columns)).groupBy("a", "g").applyInArrow(run, f"query {kind}, id {kind}, score double")


def nearest_of_all(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query, id, place): the k rows nearest to every row by cosine, itself left out; equal similarities go by id.

    Rows without an id, and null or zero vectors, have no neighbours and are none; vectors must be of one length. Where
    fewer than k others exist there are fewer rows; repeated rows of one id count once; an empty table gives no rows.
    """
    spark, folder = vectors.sparkSession, f"{work_folder(vectors.sparkSession)}/neighbours-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    distinct = kept(distinct_vectors(vectors, k, id_col, vector_col), "distinct")
    many = distinct.count()
    if not many:
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"query {kind}, id {kind}, place int")
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(min(pivots, int(np.ceil(np.sqrt(many))))).select("vector")
    points = np.array([r.vector for r in sample.collect()], np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    members = kept(in_cells(distinct, points), "cells")
    stats = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    radius, size = np.full(len(points), -np.inf), np.zeros(len(points), np.int64)
    for r in stats:
        radius[r.cell], size[r.cell] = r.radius, r.n
    # The first pivots, which are as random as all, gather the cells nearest to them in a tile.
    tiles = _distances(points, points[: max(1, -(-many // BLOCK))]).argmin(axis=1).astype(np.int32)
    parts = {t: max(1, -(-int(size[tiles == t].sum()) // BLOCK)) for t in range(int(tiles.max()) + 1)}
    made = kept(blocks(members, k, points, radius, tiles, parts), "blocks")
    own = made.select(F.explode(F.arrays_zip("query", "id", "score")).alias("x")).select("x.query", "x.id", "x.score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = own.unionByName(meetings(made, k)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x.id).alias("found"))
    best = distinct.join(lists, F.col("rep") == F.col("query")).select("vector", "found")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("query"), F.col(vector_col).alias("vector")).distinct()
    others = F.slice(F.filter("found", lambda x: x != F.col("query")), 1, k)
    return rows.join(best, "vector").select("query", F.posexplode(others).alias("place", "id")).select("query", "id", (F.col("place") + 1).alias("place"))
