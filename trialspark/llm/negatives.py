"""Hard-negative mining by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into keys (anchor, descending score, kind, id), dealt by anchor and
sorted on the way (`repartitionAndSortWithinPartitions`). An iterator streams over each partition: a positive
opens a score window, and the negatives that follow are emitted into the open windows. An anchor never stands
in memory; only its open windows do, at most as many as positives are asked for.

Anchors are taken in blocks of bounded size, each of which is broadcast and meets every row where the row lies,
so rows are not shuffled. Two scans of the rows cut the pairs before they are shuffled, without losing any:
the first keeps each task's best rows of the anchor's label, the second, which knows the positives, each
task's best rows inside each window. What an answer can hold is among them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from trialspark.llm.common import held
from trialspark.llm.vectors import usable

#: Components of the anchors that are held at once (8 bytes each).
BLOCK_COMPONENTS = 1 << 20
#: Rows and anchors whose scores are computed together.
ROWS, ANCHORS = 2048, 1024
LOWEST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
#: Key: anchor, score turned round, kind (0 positive, 1 negative), id, row; compares bytewise like the tuple.
KEY = ">QQBQQ"
TURN, SIGN = (1 << 64) - 1, 1 << 63


def _key(anchor: int, score: int, kind: int, key: int, row: int) -> bytes:
    return struct.pack(KEY, anchor, TURN - (score + SIGN), kind, key + SIGN, row)


def _read(key: bytes) -> tuple[int, int, int, int, int]:
    anchor, score, kind, vec_id, row = struct.unpack(KEY, key)
    return anchor, TURN - score - SIGN, kind, vec_id - SIGN, row


class Best:
    """The `k` best (score, id, row) of each slot: greatest score, then smallest id."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), LOWEST, np.int64)
        self.id = np.full((slots, k), LAST, np.int64)
        self.row = np.full((slots, k), LAST, np.int64)

    def add(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of (slot, row) pairs, where allowed."""
        k = self.score.shape[1]
        good = allowed & (scores >= self.score[slots, -1][:, None])
        if good.sum() > 4 * k * len(slots) and scores.shape[1] > k:  # the kth best here bounds what can count
            low = np.where(good, scores, LOWEST)
            good &= scores >= np.partition(low, -k, axis=1)[:, -k][:, None]
        at, place = np.nonzero(good)
        if not len(at):
            return
        touched = np.unique(at)
        old = slots[touched]
        where = np.concatenate([np.repeat(touched, k), at])
        s = np.concatenate([self.score[old].ravel(), scores[at, place]])
        i = np.concatenate([self.id[old].ravel(), ids[place]])
        r = np.concatenate([self.row[old].ravel(), rows[place]])
        order = np.lexsort((r, i, -np.maximum(s, LOWEST + 1), where))
        first = np.searchsorted(where[order], touched)
        pick = order[(first[:, None] + np.arange(k))]
        self.score[old], self.id[old], self.row[old] = s[pick], i[pick], r[pick]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slot, score, id and row of all that was added."""
        slot, place = np.nonzero(self.row < LAST)
        return slot, self.score[slot, place], self.id[slot, place], self.row[slot, place]


class Anchors:
    """Anchors of one block and one vector length."""

    def __init__(self, rows: list):
        self.row = np.array([r.row for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.vec = np.array([r.vec for r in rows], np.int64)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(anchors, scores, labels, ids, rows) of all pairs, a bounded number at a time; row numbers are those of the table."""
        dim = self.vec.shape[1]
        for whole in batches:
            lists = whole.column("vec")
            fit = whole.filter(pc.equal(pc.list_value_length(lists), dim))
            for at in range(0, fit.num_rows, ROWS):
                batch = fit.slice(at, ROWS)
                data = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                row, key, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
                for start in range(0, len(self.row), ANCHORS):
                    some = np.arange(start, min(start + ANCHORS, len(self.row)))
                    yield some, _inner(self.vec[some], data), label, key, row


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all of b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _positives(rows: DataFrame, anchors, k: int) -> DataFrame:
    """(anchor, score, vec_id, row): the k best rows of the anchor's label of each task; anchor is its row number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Anchors = anchors.value
        best = Best(len(own.row), k)
        for some, scores, label, key, row in own.scored(batches):
            allowed = (own.label[some][:, None] == label) & (own.row[some][:, None] != row)
            best.add(some, scores, allowed, key, row)
        slot, score, key, row = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(own.row[slot]), pa.array(score), pa.array(key), pa.array(row)], names=["anchor", "score", "vec_id", "row"])

    return rows.mapInArrow(run, "anchor long, score long, vec_id long, row long")


def _negatives(rows: DataFrame, anchors, windows, k: int, low: int, high: int) -> DataFrame:
    """(anchor, score, vec_id, row): the k best rows of other labels of each task inside each window of an anchor, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Anchors = anchors.value
        bounds = windows.value  # (anchor, window): scores of the positives, None as masked
        best = Best(bounds.size, k)
        wide = bounds.shape[1]
        for some, scores, label, key, row in own.scored(batches):
            other = own.label[some][:, None] != label
            for w in range(wide):
                edge = bounds[some, w]
                has = ~np.ma.getmaskarray(edge)
                if has.any():
                    lo, hi = _window(edge.data, low, high)
                    inside = other & has[:, None] & (scores >= lo[:, None]) & (scores <= hi[:, None])
                    best.add(some * wide + w, scores, inside, key, row)
        slot, score, key, row = best.found()
        anchor = own.row[slot // wide]
        once = np.unique(np.stack([anchor, row]), axis=1, return_index=True)[1] if len(row) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (anchor, score, key, row)], names=["anchor", "score", "vec_id", "row"])

    return rows.mapInArrow(run, "anchor long, score long, vec_id long, row long")


def _window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score with low * score <= 100 * negative <= high * score."""
    whole, rest = np.divmod(score, 100)  # products of the parts cannot overflow where scores fit 56 bits
    return whole * low - (-rest * low // 100), whole * high + rest * high // 100


class Windows:
    """What streams over a sorted partition keeps of the current anchor: its open windows."""

    def __init__(self, positives: int, negatives: int, low: int, high: int):
        self.positives, self.negatives, self.low, self.high = positives, negatives, low, high

    def __call__(self, pairs: Iterator[tuple[bytes, tuple]]) -> Iterator[tuple]:
        current, opened, seen = None, [], 0
        for key, anchor_id in pairs:
            anchor, score, kind, vec_id, _ = _read(key)
            if anchor != current:
                current, opened, seen = anchor, [], 0
            if kind == 0:
                seen += 1
                if seen <= self.positives:
                    opened.append([vec_id, score, 0])
                continue
            for window in opened:
                positive_id, positive, rank = window
                if self.low * positive <= 100 * score <= self.high * positive and rank < self.negatives:
                    window[2] += 1
                    yield anchor_id, positive_id, rank + 1, vec_id, positive, score
            opened = [w for w in opened if w[2] < self.negatives]


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
         id_col: str = "vec_id", vector_col: str = "embedding", block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Scores are inner products of floor(scale * x); higher scores come first, ties by smaller id. The positives of an
    anchor are its first `positives` other rows of its label; of each, the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are given (all, if fewer).

    Rows with a null id, a null label, a null or empty vector or a null or non-finite component take no part; vectors of
    another length are no partners. Scores have to fit 56 bits. Rows that repeat an id are rows of their own: anchors, positives and
    negatives each, equal ones in any order. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    table = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).withColumn("__label", label).filter("__label IS NOT NULL")
    table = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col("__label").cast("long").alias("label"), is_anchor.alias("asked"),
                         F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))
    rows = held(table, "scaled")
    data = rows.select("row", "vec_id", "label", "vec")
    pairs = []
    for (dim,) in rows.filter("asked").select(F.size("vec")).distinct().orderBy(F.size("vec")).collect():
        size = max(1, block_components // dim)
        asked = rows.filter("asked").filter(F.size("vec") == dim)
        after, found = -1, None
        while True:
            # the anchors after those done so far, a bounded number
            block = asked.filter(F.col("row") > after).orderBy("row").limit(size).select("row", "label", "vec").collect()
            if not block:
                break
            after = block[-1]["row"]
            anchors = spark.sparkContext.broadcast(Anchors(block))
            near = held(_positives(data, anchors, positives), "positives")
            windows = spark.sparkContext.broadcast(_edges(near, anchors.value, positives))
            far = held(_negatives(data, anchors, windows, negatives, low, high), "negatives")
            found = near.withColumn("kind", F.lit(0)).unionByName(far.withColumn("kind", F.lit(1)))
            pairs.append(found)
            if len(block) < size:
                break
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not pairs:
        return spark.createDataFrame([], schema)
    whole = pairs[0]
    for more in pairs[1:]:
        whole = whole.unionByName(more)
    ids = rows.filter("asked").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    whole = whole.join(ids, "anchor").select("anchor", "score", "kind", "vec_id", "row", "anchor_id")
    keyed = whole.rdd.map(lambda r: (_key(r[0], r[1], r[2], r[3], r[4]), r[5]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = keyed.repartitionAndSortWithinPartitions(parts, partitionFunc=lambda key: zlib.crc32(key[:8])).mapPartitions(Windows(positives, negatives, low, high))
    return spark.createDataFrame(stream, schema)


def _edges(near: DataFrame, anchors: Anchors, k: int) -> np.ma.MaskedArray:
    """Scores of the k best positives of each anchor of a block."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("anchor", "rank", "score").toPandas()  # k rows an anchor at most
    place = np.argsort(anchors.row)
    out = np.ma.masked_all((len(anchors.row), k), np.int64)
    at = place[np.searchsorted(anchors.row, best["anchor"].to_numpy(), sorter=place)]
    out[at, best["rank"].to_numpy() - 1] = best["score"].to_numpy()
    return out
