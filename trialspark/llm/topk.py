"""Exact top-k by inner product with dual cover trees.

Queries and data are indexed together: both are dealt to the same pivots and cut into blocks, each with a
centre and a covering radius, and inside a block a cover tree halves the radii further down. For a pair of
nodes with centres q, p and radii r, s no inner product exceeds q.p + r|p| + s|q| + rs; the pair is pruned
when that stays below the worst kth score of the query node. First every query block meets one block of its
own cell, which gives the scores that prune pairs of blocks before they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trialspark.llm.common import held
from trialspark.llm.vectors import BLOCK, bounded_sample, packed, rows_of, unpacked, usable

LEAF = 64
FANOUT = 8
NONE = -np.iinfo(np.int64).max


class Node:
    """Points `rows` within `radius` of `centre`; children cover the same points with smaller radii."""

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        self.rows = rows
        own = points[rows]
        self.centre = own.mean(axis=0)
        self.size = np.sqrt(self.centre @ self.centre)
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(axis=1).max()))
        self.children: list[Node] = []
        if len(rows) <= LEAF or self.radius == 0:
            return
        # centres of the next level: the point farthest from those chosen, until half the radius covers all
        gap = ((own - own[0]) ** 2).sum(axis=1)
        owner = np.zeros(len(rows), np.int64)
        for child in range(1, FANOUT):
            far = int(gap.argmax())
            if gap[far] * 4 <= self.radius**2:
                break
            d = ((own - own[far]) ** 2).sum(axis=1)
            owner[d < gap] = child
            gap = np.minimum(gap, d)
        parts = [rows[owner == c] for c in range(owner.max() + 1)]
        self.children = [Node(points, part) for part in parts if len(part)] if len(parts) > 1 else []


class Best:
    """The k best (score, id) of each query, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE, np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, np.int64)
        self.node = np.zeros((queries, k), np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, nodes: np.ndarray) -> None:
        if (scores >= self.score[rows, -1][:, None]).any():
            k = self.score.shape[1]
            s = np.concatenate([self.score[rows], scores], axis=1)
            i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
            n = np.concatenate([self.node[rows], np.broadcast_to(nodes, scores.shape)], axis=1)
            order = np.lexsort((n, i, -s), axis=1)[:, :k]
            for own, all_ in ((self.score, s), (self.id, i), (self.node, n)):
                own[rows] = np.take_along_axis(all_, order, 1)


def search(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, nodes: np.ndarray, best: Best, floor: np.ndarray) -> None:
    """Raise `best` by the data; scores below `floor`, a known kth score of each query, cannot count."""
    exact = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1] < 2**52
    whole = (queries, data) if exact else (queries.astype(np.int64), data.astype(np.int64))
    slack = 1e-9 * (1 + np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1])

    def visit(q: Node, p: Node) -> None:
        worst = np.maximum(best.score[q.rows, -1], floor[q.rows]).min()
        if q.centre @ p.centre + q.radius * p.size + p.radius * q.size + q.radius * p.radius + slack < worst:
            return
        if not q.children and not p.children:
            scores = whole[0][q.rows] @ whole[1][p.rows].T
            best.add(q.rows, scores.astype(np.int64), ids[p.rows], nodes[p.rows])
        elif q.children and (not p.children or q.radius > p.radius):
            for child in q.children:
                visit(child, p)
        else:  # likely parts first: they raise the worst kth score
            for child in sorted(p.children, key=lambda c: -(q.centre @ c.centre + q.size * c.radius)):
                visit(q, child)

    visit(Node(queries, np.arange(len(queries))), Node(data, np.arange(len(data))))


def _met(pairs: DataFrame, k: int, first: bool) -> DataFrame:
    """Best rows of each query of a block against the data blocks it is paired with.

    first: one row for each block, with scores and the block itself, else one for each improved result.
    """
    def best_of(row: dict, floor: np.ndarray | None) -> tuple[np.ndarray, Best]:
        (node, _), q = unpacked(row["ids"], row["data"], row["n"])
        (nodes, ids), p = unpacked(row["ids_b"], row["data_b"], row["n_b"])
        best = Best(len(q), k)
        search(q, p, ids, nodes, best, np.full(len(q), NONE) if floor is None else floor)
        return node, best

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, best = best_of(row, None)
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "floor": best.score[:, -1].tobytes(), "worst": int(best.score[:, -1].min())}], schema=pa.schema([("block", pa.int64()), ("floor", pa.binary()), ("worst", pa.int64())]))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            floor = np.frombuffer(row["floor"], np.int64)
            node, best = best_of(row, floor)
            at, place = np.nonzero((best.score > NONE) & (best.score >= floor[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(best.node[at, place]), pa.array(best.id[at, place]), pa.array(best.score[at, place])], names=["node", "found", "first_id", "score"])

    if first:
        return pairs.mapInArrow(start, "block long, floor binary, worst long")
    return pairs.mapInArrow(results, "node long, found long, first_id long, score long")


def _blocks(distinct: DataFrame, pivots: np.ndarray, label: str) -> DataFrame:
    """(block, cell, cells, n, ids, data, centre, radius, size) of vectors dealt to their nearest pivots, blocks numbered from 0."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("node", pa.int64()), ("vec_id", pa.int64()), ("vec", pa.list_(pa.int64())), ("cell", pa.int32())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = np.stack([np.array(v, np.float64) for v in batch.column(2).to_pylist()])
            cell = ((p * p).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], schema=schema)

    cells = held(distinct.select("node", "vec_id", "vec").mapInArrow(assign, "node long, vec_id long, vec array<long>, cell int"), label)
    counts = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most one row for each pivot
    starts, numbers, at = {}, {}, 0
    for cell in sorted(counts):
        starts[cell], numbers[cell] = at, -(-counts[cell] // BLOCK)
        at += numbers[cell]
    rows = distinct.sparkSession.createDataFrame([(c, starts[c], numbers[c]) for c in starts], "cell int, start long, parts long")
    dealt = cells.join(F.broadcast(rows), "cell").withColumn("block", F.col("start") + F.pmod(F.xxhash64("node"), F.col("parts")))
    block = packed(dealt, ["block", "cell", "start", "parts"], ["node", "vec_id"], "vec")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                _, x = unpacked(row["ids"], row["data"], row["n"])
                centre = x.mean(axis=0)
                more = {"centre": centre.tolist(), "radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())), "size": float(np.sqrt(centre @ centre))}
                yield pa.RecordBatch.from_pylist([row | more], schema=pa.schema([*batch.schema, ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("size", pa.float64())]))

    return held(block.mapInArrow(bound, "block long, cell int, start long, parts long, n int, ids binary, data binary, centre array<double>, radius double, size double"), label + "-blocks")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 4096, pivots: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row.

    Components become floor(scale * x); is_query is a condition on the id column. All rows but the query's
    own are candidates; ties go to the smaller id; fewer candidates give fewer rows. Null or empty
    vectors, vectors with null or non-finite components and rows with a null id take no part; vectors of
    another length are no candidates. Scores have to fit 64 bits. Rows that repeat an id are rows of their own: each
    is a candidate of the others, and each asks its own query. Equal vectors are indexed once, with their k + 1 smallest ids (no more can be answers). Pivots come from at most `sample`
    vectors; every vector is indexed and the result is exact.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    rows = held(rows.withColumn("node", F.xxhash64("vec")).withColumn("query", is_query(F.col("vec_id"))), "scaled")
    rank = F.row_number().over(Window.partitionBy("node", "vec").orderBy("vec_id"))
    few = held(rows.select("node", "vec", "vec_id").withColumn("place", rank).filter(F.col("place") <= k + 1), "few")
    out = []
    for (dim,) in few.select(F.size("vec")).distinct().collect():
        own = few.filter(F.size("vec") == dim)
        heads = own.filter("place = 1").select("node", "vec_id", "vec")
        points = bounded_sample(heads, "vec", "node", sample)
        chosen = [0]
        near = ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < pivots and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        asked = rows.filter("query").filter(F.size("vec") == dim).groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec"))
        data = _blocks(heads, points[chosen], "data")
        ask = _blocks(asked, points[chosen], "queries")
        cell = data.filter("block = start").select(*[F.col(c).alias(c + "_b") for c in ("block", "n", "ids", "data")], "cell")
        first = held(_met(ask.join(cell, "cell"), k + 1, True), "first")
        ask = ask.join(first, "block")
        count = data.count()
        line = data.select(*[F.col(c).alias(c + "_b") for c in ("block", "centre", "radius", "size")])
        grid = ask.select("block", "centre", "radius", "size", "worst").withColumn("block_b", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))).join(line, "block_b")
        inner = F.aggregate(F.zip_with("centre", "centre_b", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        grid = grid.withColumn("inner", inner).filter("inner + radius * size_b + radius_b * size + radius * radius_b + 1e-6 * (1 + abs(inner)) >= worst").select("block", "block_b")
        full = data.select(*[F.col(c).alias(c + "_b") for c in ("block", "n", "ids", "data")])
        met = _met(grid.join(ask.select("block", "n", "ids", "data", "floor"), "block").join(full, "block_b"), k + 1, False)
        out.append(held(met, "met"))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    met = out[0]
    for more in out[1:]:
        met = met.unionByName(more)
    # k + 1 vectors, then k + 1 rows of each distinct query; the query's own row is taken out of these
    order = Window.partitionBy("node").orderBy(F.desc("score"), "first_id", "found")
    met = met.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    whole = met.join(few.select(F.col("node").alias("found"), "vec_id", "place"), "found")
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id", "place")
    whole = whole.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    answers = whole.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "found", "vec_id", "score"))).alias("list"))
    asked = rows.filter("query").select("node", F.col("vec_id").alias("query_id"))
    own = F.expr("coalesce(get(filter(list, x -> x.vec_id = query_id AND x.found = node), 0).at, 0)")
    best = asked.join(answers, "node").withColumn("own", own)
    best = best.select("query_id", F.posexplode(F.expr(f"slice(filter(list, x -> x.at <> own), 1, {k})")).alias("rank", "x"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
