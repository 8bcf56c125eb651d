"""Embedding near-dedup: spherical k-means cells of short signatures, then blocked cosine products of the vectors that may link.

Two unit vectors that link are at most reach = sqrt(2 - 2 * threshold) apart. A signature is the place of a unit vector
on at most AXES orthonormal axes, in whole steps. A projection lengthens no distance and rounding adds a step an axis at most,
so the signatures of linked vectors lie within a known distance; these are whole numbers, compared without rounding.

A signature belongs to the cell of its vector's nearest centre. A vector can have a link across the border to another cell
only if it lies within reach of the plane between both centres; its signature is shown to that cell as a guest. Each pair of
neighbouring cells sends guests one way, which finds every pair once. Signatures that lie close form parts; every link lies
inside a part, so only the vectors of parts are gathered and compared. The search is exact, whatever
sample the centres and axes were fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import held
from trialspark.llm.components import components
from trialspark.llm.vectors import BLOCK, bounded_sample, packed, rows_of, unpacked, usable
from trialspark.operators.scan import bitmap_semi

#: Axes of a signature, its step, and the signatures of a block.
AXES, STEP, SIGNATURES = 24, 1 / 64, 65536
#: Cells an average vector may be shown to; where it would be more, fewer cells are made.
SHOWN = 2.0


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of unit vectors; starts from spread-out vectors, deterministic."""
    first = [0]
    near = vectors @ vectors[0]
    for _ in range(min(k, len(vectors)) - 1):
        first.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[first[-1]])
    centres = vectors[first]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, total / np.maximum(length, 1e-12), centres)
    return np.unique(centres.round(12), axis=0)


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal axes (columns) along which the vectors differ most."""
    mean = vectors.mean(axis=0)
    return mean, np.linalg.eigh((vectors - mean).T @ (vectors - mean))[1][:, ::-1][:, :AXES]


def _shown(vectors: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each unit vector, and (vector, cell) of the guests.

    Guests go to lower cells only: every pair of cells compares its border once.
    """
    near = vectors @ centres.T
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) if len(centres) > 256 else np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    guests = near[np.arange(len(own)), own][:, None] - near <= reach * apart[own]
    return own, *np.nonzero(guests & (np.arange(len(centres))[None, :] < own[:, None]))


def _centres(sample: np.ndarray, most: int, reach: float) -> np.ndarray:
    """At most `most` centres: of that many, a half, a quarter and so on down to one those that leave the fewest pairs to compare."""
    best, least = sample[:1], len(sample) ** 2
    while most > 1:
        centres = spherical_kmeans(sample, most)
        own, _, guest_of = _shown(sample, centres, reach)
        pairs = int((np.bincount(np.concatenate([own, guest_of])) ** 2).sum())
        if pairs < least and len(own) + len(guest_of) <= SHOWN * len(own):
            best, least = centres, pairs
        most //= 2
    return best


def _cells(good: DataFrame, centres: np.ndarray, axes: tuple[np.ndarray, np.ndarray], reach: float) -> DataFrame:
    """(label, dim, cell, guest, node, signature): each vector in its cell, and as a guest of others.

    Vectors of another length than the centres share a cell and have their first components as axes.
    """
    shared = good.sparkSession.sparkContext.broadcast((centres, *axes))
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("guest", pa.bool_()), ("node", pa.int64()), ("signature", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, mean, turn = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lengths = pc.list_value_length(part.column(2)).to_numpy()
                flat, starts = part.column(2).flatten().to_numpy().astype(np.float64), np.cumsum(lengths) - lengths
                for dim in np.unique(lengths):
                    which = np.flatnonzero(lengths == dim)
                    x = units(flat[starts[which][:, None] + np.arange(dim)])
                    if len(c) and dim == c.shape[1]:
                        own, row, guest_of = _shown(x, c, reach)
                        place = (x - mean) @ turn
                    else:
                        own, row, guest_of, place = np.zeros(len(x), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), x[:, :AXES]
                    row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([own, guest_of])
                    signs = np.clip(np.rint(place / STEP), -127, 127).astype(np.int8)[row]  # clipping lengthens no distance either
                    signs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, signs.size + 1, signs.shape[1], dtype=np.int32).tobytes()), pa.py_buffer(signs.tobytes())])
                    picked = pa.array(which[row])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(picked), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)),
                                                      pa.array(cell != own[row]), part.column(1).take(picked), signs], schema=schema)

    return good.select("label", "node", "vec").mapInArrow(assign, "label string, dim int, cell int, guest boolean, node long, signature binary")


def _signature_blocks(cells: DataFrame) -> DataFrame:
    """(label, dim, cell, block, blocks, n, ids, guests, data): at most about SIGNATURES signatures of a cell in a row."""
    key = ["label", "dim", "cell"]
    count = held(cells.groupBy(*key).agg(F.ceil(F.count("*") / SIGNATURES).cast("int").alias("blocks")), "cell-counts")
    dealt = cells.join(F.broadcast(count) if count.count() <= 100_000 else count, key)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "guest"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        out = {c: table.column(c).slice(0, 1) for c in [*key, "block", "blocks"]}
        out |= {"n": pa.array([table.num_rows], pa.int32()), "ids": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
                "guests": pa.array([table.column("guest").to_numpy().tobytes()], pa.binary()), "data": pa.array([b"".join(table.column("signature").to_pylist())], pa.binary())}
        return pa.table(out)

    schema = "label string, dim int, cell int, block int, blocks int, n int, ids binary, guests binary, data binary"
    return dealt.select(*key, "block", "blocks", "node", "guest", "signature").groupBy(*key, "block", "blocks").applyInArrow(pack, schema)


def _paired(block: DataFrame, key: list[str]) -> DataFrame:
    """Every block by itself (its partner is null) and with each later block of its cell; only cells of several blocks are shuffled."""
    parts = [c for c in block.columns if c not in (*key, "block", "blocks")]
    other = block.filter("block > 0").select(*key, F.col("block").alias("block_b"), *[F.col(c).alias(c + "_b") for c in parts])
    two = block.filter("block + 1 < blocks").withColumn("block_b", F.explode(F.expr("sequence(block + 1, blocks - 1)"))).join(other, [*key, "block_b"])
    one = block.select(*parts, *[F.lit(None).cast(block.schema[c].dataType).alias(c + "_b") for c in parts])
    return one.unionByName(two.select(*one.columns))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places is joined to by the edges (a, b)."""
    low = np.arange(n)
    while True:
        least, new = np.minimum(low[a], low[b]), low.copy()
        for end in (a, b, low[a], low[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _close(pairs: DataFrame, reach: float, tile: tuple[int, int] = (256, 2048)) -> DataFrame:
    """(node, to) from pairs of blocks of signatures: a vector that may link, and one of those it is joined to."""
    def read(row: dict, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = row["n" + end]
        return np.frombuffer(row["ids" + end], np.int64), np.frombuffer(row["guests" + end], np.bool_), np.frombuffer(row["data" + end], np.int8).reshape(n, -1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, wide = tile
        for row in rows_of(batches):
            ids, guest_a, a = read(row, "")
            alone = row["n_b"] is None
            more, guest_b, b = (ids, guest_a, a) if alone else read(row, "_b")
            offset, ids = (0, ids) if alone else (len(ids), np.concatenate([ids, more]))
            # whole numbers below 2**24: distances come out exactly
            limit = math.floor((reach / STEP + math.sqrt(a.shape[1]) + 1e-6) ** 2)
            one, square_a, square_b = np.ones((max(len(a), len(b)), 1), np.float32), (a * a).sum(axis=1, keepdims=True), (b * b).sum(axis=1, keepdims=True)
            left, right = np.hstack([a, square_a, one[: len(a)]]), np.ascontiguousarray(np.hstack([-2 * b, one[: len(b)], square_b]).T)
            edges = []
            for i in range(0, len(a), high):
                for j in range(i // wide * wide if alone else 0, len(b), wide):
                    far = left[i:i + high] @ right[:, j:j + wide]
                    if alone and j < i + high and i < j + wide:
                        same = np.arange(max(i, j), min(i + far.shape[0], j + far.shape[1]))
                        far[same - i, same - j] = np.inf
                    if far.min() > limit:
                        continue
                    near = (far <= limit) & ~(guest_a[i:i + high, None] & guest_b[None, j:j + wide])  # guests meet in their own cell
                    edges.append(_edges(near, np.arange(i, i + near.shape[0]), np.arange(offset + j, offset + j + near.shape[1])))
            if edges:
                low = _joined(len(ids), *np.concatenate(edges, axis=1))
                some = np.flatnonzero(low != np.arange(len(low)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]])], names=["node", "to"])

    return pairs.mapInArrow(run, "node long, to long")


def _least_label(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside a block of links between two sets of vectors."""
    big = np.iinfo(np.int64).max
    a, b = ids_a.copy(), ids_b.copy()
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], big).min(axis=1))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], big).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _edges(linked: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Pairs of places that join what the links of a tile join: the links themselves, or one pair a place where they are many."""
    some_a, some_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked, at_a, at_b = linked[np.ix_(some_a, some_b)], at_a[some_a], at_b[some_b]
    if np.count_nonzero(linked) > 4 * sum(linked.shape):
        return np.stack([np.concatenate([at_a, at_b]), np.concatenate(_least_label(linked, at_a, at_b))])
    a, b = np.nonzero(linked)
    return np.stack([at_a[a], at_b[b]])


def _compare(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, to, links) from pairs of blocks: links of a vector into the other block, and one id it is connected to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            (ids, many), a = unpacked(row["ids"], row["data"], row["n"])
            a, alone = units(a), row["n_b"] is None
            b, offset = a, 0
            if not alone:
                (id_b, many_b), b = unpacked(row["ids_b"], row["data_b"], row["n_b"])
                b, offset, ids, many = units(b), len(ids), np.concatenate([ids, id_b]), np.concatenate([many, many_b])
            links, edges = np.zeros(len(ids), np.int64), []
            for i in range(0, len(a), BLOCK):
                for j in range(i if alone else 0, len(b), BLOCK):
                    linked = a[i:i + BLOCK] @ b[j:j + BLOCK].T >= threshold
                    same = alone and i == j
                    if same:
                        np.fill_diagonal(linked, False)
                    if not linked.any():
                        continue
                    at_a, at_b = np.arange(i, i + linked.shape[0]), np.arange(offset + j, offset + j + linked.shape[1])
                    links[at_a] += linked @ many[at_b]
                    if not same:
                        links[at_b] += many[at_a] @ linked
                    edges.append(_edges(linked, at_a, at_b))
            if edges:
                some, low = links > 0, _joined(len(ids), *np.concatenate(edges, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[low[some]]), pa.array(links[some])], names=["node", "to", "links"])

    return pairs.mapInArrow(run, "node long, to long, links long")


def _candidates(good: DataFrame, nodes: DataFrame, threshold: float, sample: int, cell_rows: int, max_cells: int) -> DataFrame:
    """(id, component_id) of the vectors that may link: every link lies inside a component."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    few = nodes.select("label", "node").orderBy(F.xxhash64("node"), "node").limit(sample)
    some = bounded_sample(good.join(F.broadcast(few), ["label", "node"]).dropDuplicates(["label", "node"]), "vec", "node", sample)
    centres, axes = some, (np.empty(0), np.empty((0, 0)))
    if len(some):
        some = units(some)
        axes = principal_axes(some)
        centres = _centres(some, min(max_cells, max(1, largest // cell_rows)), reach)
    cells = held(_cells(good, centres, axes, reach).distinct(), "cells")
    pairs = _paired(held(_signature_blocks(cells), "signatures"), ["label", "dim", "cell"])
    return components(held(_close(pairs, reach), "close"), "node", "to")


def _blocks(good: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(label, dim, large, cell, block, blocks, n, ids, data): vectors of parts; small parts share a cell, a large one is cut into four blocks or more."""
    parts = held(parts, "parts")
    size = parts.groupBy("component_id").agg(F.count("*").alias("rows"))
    shared = max(1, -(-parts.count() // (BLOCK // 2)))
    large = F.col("rows") > BLOCK // 2
    placed = parts.join(size, "component_id").withColumnRenamed("id", "node").select(
        "node", large.alias("large"), F.when(large, F.col("component_id")).otherwise(F.pmod(F.xxhash64("component_id"), F.lit(shared))).alias("cell"),
        F.when(large, F.greatest(F.lit(4), F.ceil(F.col("rows") / (8 * BLOCK)))).otherwise(1).cast("int").alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    placed = held(nodes.select("label", "node", "copies").join(placed, "node"), "placed")
    vectors = bitmap_semi(good.select("label", "node", "vec"), placed, ["node"]).groupBy("label", "node").agg(F.first("vec").alias("vec"))
    key = ["label", "dim", "large", "cell", "block", "blocks"]
    return packed(vectors.join(placed, ["label", "node"]).withColumn("dim", F.size("vec")), key, ["node", "copies"], "vec")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = 8192, cell_rows: int = 2048, max_cells: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors of equal, non-null label and equal length link when their cosine, in double precision, is at
    least `threshold`. n_links counts the other vectors linked directly, component_id is the smallest vec_id
    reachable (its own included), kept says that it is its own. Null or empty vectors, zero vectors and
    vectors with null or non-finite components link with nothing and are kept; so are rows of null label.
    Equal vectors (told by 64 bits of hash) are compared once and counted each; rows with a null id are not linked. Repeated ids count
    as separate vectors of one id. Centres and axes are fitted on at most `sample` vectors, as many centres as
    give the largest label cells of about cell_rows vectors, or fewer where so many cells would leave more pairs to compare; every vector is indexed.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    good = rows.filter(usable("vec") & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn("node", F.xxhash64("label", "vec"))
    nodes = held(good.groupBy("label", "node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "nodes")
    block = held(_blocks(good, nodes, _candidates(good, nodes, threshold, sample, cell_rows, max_cells)), "blocks")
    found = held(_compare(_paired(block, ["label", "dim", "large", "cell"]), threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found, "node", "to").withColumnRenamed("id", "node").withColumnRenamed("component_id", "part")
    met = held(nodes.select("label", "node", "rep").join(links.join(parts, "node"), "node"), "met")
    met = met.join(met.groupBy("part").agg(F.min("rep").alias("least")), "part").select("label", "node", "links", "least")
    facts = nodes.join(met, ["label", "node"], "left").select("label", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = good.select("label", "node", "vec_id").join(facts, ["label", "node"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(usable("vec") & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(vectors: DataFrame, **settings) -> DataFrame:
    """The rows of `vectors` that are kept: one of each group of near duplicates."""
    key = settings.get("id_col", "vec_id")
    gone = near_duplicates(vectors, **settings).filter("NOT kept").select(F.col("vec_id").alias(key)).distinct()
    return vectors.join(gone, key, "left_anti")
