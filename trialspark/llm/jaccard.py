"""N-gram Jaccard join: all pairs of documents whose word-shingle sets are similar enough.

Method: set-relation skipping. Each set is indexed under its rarest shingles only (prefix filter),
and two relations between sets save work.

* Index level: the entries of a shingle's list carry the set size and the position of the shingle in
  its set. Entries of like size and position form a block; a pair of blocks whose sizes or positions
  cannot reach the threshold is skipped whole, and so is a pair of sets with too few common lists.
* Answer level: a set that is highly similar to an already answered set (its leader) takes over the
  leader's answers. With the exact distance d(p, q) between two leaders and the distances d(e, p),
  d(f, q) of their members, |d(p, q) - d(e, p) - d(f, q)| bounds d(e, f): most member pairs are
  settled without being read, and only the rest is compared.

Pairs that are already connected are never produced, so a group of copies costs its size, not its
square; no link between sets of different components is lost, so components are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import RangeHash, by_id, held, in_chunks, near_semi, text_rows, word_hashes
from trialspark.llm.components import components

#: Shingles are counted in 2**SKETCH_BITS hash buckets; those of rare buckets come first in the order of
#: shingles. Any order gives the same result: the number bounds memory and never changes the answer.
SKETCH_BITS = 19


def shingles_of(text: bytes, words: int, ranges: RangeHash) -> np.ndarray:
    """Hashes of the word shingles of a text, in order; A-Z are lower-cased first."""
    hashes = word_hashes(text, lower=True)
    n = len(hashes)
    if not n:
        return hashes
    left = np.arange(max(1, n - words + 1))
    return ranges.ranges(ranges.sums(hashes), left, np.minimum(left + words, n))


#: Buckets that are summed in one group.
SLICE = 1 << 14


#: Shingles that are counted at once (one text may have more).
COUNTED = 1 << 17


def _bunches(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The arrays one after the other, in bunches of bounded length."""
    some: list[np.ndarray] = []
    size = 0
    for found in arrays:
        some.append(found)
        size += len(found)
        if size >= COUNTED:
            yield np.concatenate(some)
            some, size = [], 0
    if some:
        yield np.concatenate(some)


def bucket_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles fall into each hash bucket, over all documents (2**19 numbers).

    Tasks count first and send each slice of the buckets as one row of bytes.
    """
    shift, slices = np.uint64(64 - SKETCH_BITS), (1 << SKETCH_BITS) // SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of earlier jobs of the worker
        ranges, total = RangeHash(), np.zeros(1 << SKETCH_BITS, np.int64)
        for found in _bunches(shingles_of(text, words, ranges) for _, text in text_rows(batches)):
            np.add.at(total, (found >> shift).view(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices)), pa.array([x.tobytes() for x in total.reshape(slices, SLICE)], pa.binary())], names=["slice", "n"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICE, np.int64)
        for part in parts:
            for row in part.column("n"):
                total += np.frombuffer(row.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "n"])

    rows = docs.mapInArrow(count, "slice long, n binary").groupBy("slice").applyInArrow(add, "slice long, n binary").collect()
    out = np.zeros((slices, SLICE), np.int64)
    for row in rows:
        out[row["slice"]] = np.frombuffer(row["n"], np.int64)
    return out.reshape(-1)


def shared_order(docs: DataFrame, words: int) -> Broadcast:
    """Place of each bucket in the order of shingles, rarest first; broadcast once, 2**19 numbers of 4 bytes."""
    counts = bucket_counts(docs, words)
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    return docs.sparkSession.sparkContext.broadcast(rank)


def shingle_sets(docs: DataFrame, words: int, percent: int, rank: Broadcast, whole: bool) -> DataFrame:
    """(doc_id, n, sid, keys): size, 64-bit digest and keys of each set, rarest first.

    whole: all keys, else only the prefix that a set must share with every set similar to it.
    """
    shift = np.uint64(64 - SKETCH_BITS)
    low = np.uint64((1 << (64 - SKETCH_BITS)) - 1)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ranges, order = RangeHash(), rank.value
        for doc, text in text_rows(batches):
            keys = np.unique(shingles_of(text, words, ranges))
            n = len(keys)
            sid = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "big", signed=True) if n else None
            keys = np.sort(order[(keys >> shift).astype(np.int64)].astype(np.uint64) << shift | keys & low)
            yield doc, n, sid, (keys ^ np.uint64(1 << 63)).view(np.int64)[: n if whole else n - -(-percent * n // 100) + 1]

    return docs.mapInArrow(lambda batches: in_chunks(rows(batches), schema, 256), "doc_id long, n int, sid long, keys array<long>")


class Texts:
    """Reads the whole sets of a few documents again, when pairs have to be compared."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int, rank: Broadcast):
        self.docs, self.reps, self.percent = docs, reps, percent
        self.sets = lambda some: shingle_sets(some, words, percent, rank, whole=True)

    def compared(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) with the sizes na, nb of both sets and the size `common` of their intersection."""
        sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        ids = held(sids.join(self.reps, "sid"), "compared")
        some = near_semi(self.docs, "doc_id", ids, "rep").join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = held(self.sets(some).select("sid", "n", "keys"), "sets")
        if sets.count() > ids.count():  # rows that repeat a document
            sets = held(sets.dropDuplicates(["sid"]), "sets")
        left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
        right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
        both = pairs.join(left, "a").join(right, "b")
        return both.withColumn("common", F.size(F.array_intersect("ka", "kb"))).drop("ka", "kb")

    def linked(self):
        return F.expr(f"100L * common >= {self.percent}L * (na + nb - common)")


def _rest_size(n: str, percent: int) -> str:
    """SQL for the shingles of a set of n that are not in its index."""
    return f"(({percent}L * {n} + 99) div 100 - 1)"


def _may_link(n: str, pos: str, m: str, at: str, percent: int) -> str:
    """SQL: sizes n, m and positions pos, at of one shared shingle allow a link."""
    return (f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m}) AND "
            f"{100 + percent}L * (least({pos}, {at}) + 1 + least({n} - {pos}, {m} - {at}) - 1) >= {percent}L * ({n} + {m})")


def _may_start(n: str, pos: str, m: str, at: str, percent: int) -> str:
    """SQL: a link of sets of n and m may have its first common shingle at positions pos and at.

    Nothing before it is common, so that all common shingles lie behind it. Every link has such a shingle.
    """
    return f"{100 + percent}L * least({n} - {pos}, {m} - {at}) >= {percent}L * ({n} + {m})"


def _may_share(shared: str, n: str, m: str, percent: int) -> str:
    """SQL: `shared` common shingles in both indexes allow a link of sets of n and m.

    What is common and not in both indexes lies behind the index that ends first.
    """
    return f"{100 + percent}L * ({shared} + greatest({_rest_size(n, percent)}, {_rest_size(m, percent)})) >= {percent}L * ({n} + {m})"


def _pivot_links(entries: DataFrame, label: DataFrame, texts: Texts, pick: str) -> DataFrame:
    """One verified link at most for each set: to the pivot of the lists that it shares most with.

    label: (sid, comp). The pivot of a list is the set with the fewest shingles of its own before the list's
    ("first": a group's original rather than one of its variants) or the one of greatest sid ("last"). Only sets
    of another component than the pivot are compared. Returns (a, b, gap): a linked to b, gap the size of the
    symmetric difference.
    """
    percent = texts.percent
    known = entries.join(label, "sid")
    row = F.struct("pos", "sid", "n", "comp") if pick == "first" else F.struct((-F.col("sid")).alias("other"), "sid", "n", "comp", "pos")
    pivot = known.groupBy("token").agg(F.min(row).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    near = known.join(pivot.filter("c0 < c1"), "token").filter("comp <> p.comp").filter(_may_link("n", "pos", "p.n", "p.pos", percent))
    start = F.expr(_may_start("n", "pos", "p.n", "p.pos", percent))
    best = near.groupBy(F.col("sid").alias("a"), F.col("p.sid").alias("b"), F.col("n"), F.col("p.n").alias("m")).agg(
        F.count("*").alias("shared"), F.max(start).alias("starts"))
    best = best.filter("starts").filter(_may_share("shared", "n", "m", percent))
    best = held(best.groupBy("a").agg(F.max(F.struct("shared", F.col("b").alias("b"))).alias("best")).select("a", F.col("best.b").alias("b")), "tries")
    return held(texts.compared(best).filter(texts.linked()).select("a", "b", F.expr("na + nb - 2 * common").alias("gap")), "links")


def _rest_links(entries: DataFrame, label: DataFrame, leaders: DataFrame, texts: Texts) -> DataFrame:
    """Every remaining link between sets of different components (a, b)."""
    percent = texts.percent
    room = (100 - percent) / (100 + percent)  # links have d(e, f) <= room * (n_e + n_f)
    full = entries.join(label, "sid").select("token", "sid", "n", "pos", "comp")
    mixed = full.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("token")
    full = held(full.join(mixed, "token"), "open")
    # blocks of one size class and position class; a pair of blocks out of reach is skipped whole
    full = full.withColumns({"nc": F.floor(F.log2(F.col("n").cast("double")) * 4), "pc": F.floor(F.log2(F.col("pos") + 1.0))})
    block = full.groupBy("token", "nc", "pc").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.max(F.expr("n - pos")).alias("r1"),
                                                  F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    other = block.select("token", *[F.col(c).alias(c + "_b") for c in ("nc", "pc", "n0", "n1", "p0", "r1", "c0", "c1")])
    reach = block.join(other, "token").filter(
        f"100L * n1 >= {percent}L * n0_b AND 100L * n1_b >= {percent}L * n0 AND {100 + percent}L * least(r1, r1_b) >= {percent}L * (n0 + n0_b)"
    ).filter("NOT (c0 = c1 AND c0_b = c1_b AND c0 = c0_b)").select("token", "nc", "pc", "nc_b", "pc_b")
    one = full.select("token", "nc", "pc", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    two = full.select("token", F.col("nc").alias("nc_b"), F.col("pc").alias("pc_b"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    pairs = one.join(reach, ["token", "nc", "pc"]).join(two, ["token", "nc_b", "pc_b"]).filter("ca < cb")
    pairs = pairs.filter(_may_link("na", "pa", "nb", "pb", percent)).filter(_may_start("na", "pa", "nb", "pb", percent))
    met = held(pairs.select("a", "b", "na", "nb").distinct(), "met")
    # the number of common lists, of all positions
    own = full.groupBy("sid").agg(F.collect_list("token").alias("tokens"))
    left, right = own.toDF("a", "ta"), own.toDF("b", "tb")
    met = met.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb"))).filter(_may_share("shared", "na", "nb", percent))
    lead = lambda c: leaders.select(F.col("sid").alias(c), F.col("leader").alias("l" + c), F.col("gap").alias("g" + c))
    met = met.select("a", "b", "na", "nb").join(lead("a"), "a", "left").join(lead("b"), "b", "left").select(
        "a", "b", "na", "nb", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), F.coalesce("ga", F.lit(0)).alias("ga"), F.coalesce("gb", F.lit(0)).alias("gb"))
    met = held(met, "close")
    # the answer of two leaders bounds that of their members; only what it leaves open is compared
    ends = met.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    apart = held(texts.compared(ends).select(F.col("a").alias("la"), F.col("b").alias("lb"), F.expr("na + nb - 2 * common").alias("apart")), "leaders")
    met = met.join(apart, ["la", "lb"]).filter(f"apart - ga - gb <= {room}D * (na + nb) + 1e-6")
    met = held(met.select("a", "b", F.expr(f"apart + ga + gb <= {room}D * (na + nb) - 1e-6").alias("sure")), "pairs")
    checked = texts.compared(met.filter("NOT sure").select("a", "b")).filter(texts.linked()).select("a", "b")
    return met.filter("sure").select("a", "b").unionByName(checked)


def jaccard_components(documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A document's set holds its distinct shingles of `words` lower-cased words (all its words as one
    shingle, if fewer); a text without words has an empty set and links with nothing. Documents link
    when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable, its own
    included. Null texts are empty; rows with a null doc_id come back with a null component and link with
    nothing; rows that repeat a doc_id give one row each and stand for one document with the links of all
    of them. An empty table gives an empty table. Other columns are ignored.
    """
    docs = by_id(documents, id_col, text_col)
    rank = shared_order(docs, words)
    sig = held(shingle_sets(docs, words, percent, rank, whole=False), "shingles")
    keyed = sig.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets: one representative, the rest follows it
    classes = held(keyed.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    twins = held(keyed.select("sid", "doc_id").join(classes.filter("rep < last"), "sid").filter("doc_id <> rep").select("sid", "doc_id", "rep"), "twins")
    index = keyed.join(twins.select("doc_id", "sid"), ["doc_id", "sid"], "left_anti").select("sid", "n", F.posexplode("keys").alias("pos", "token"))
    shared = index.groupBy("token").agg(F.min("sid").alias("s0"), F.max("sid").alias("s1")).filter("s0 < s1").select("token")
    entries = held(index.join(shared, "token"), "lists")
    found = twins.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if not entries.isEmpty():
        reps = classes.select("sid", "rep")
        texts = Texts(docs, reps, words, percent, rank)
        ids = held(entries.select("sid").distinct(), "listed")
        links = _pivot_links(entries, ids.withColumn("comp", F.col("sid")), texts, "first")
        leaders = links.select(F.col("a").alias("sid"), F.col("b").alias("leader"), "gap")
        links = links.select("a", "b")
        links = links.unionByName(_pivot_links(entries, _labels(ids, links), texts, "last").select("a", "b"))
        links = links.unionByName(_rest_links(entries, _labels(ids, links), leaders, texts))
        links = links.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = found.unionByName(links)
    whole = components(found)
    return sig.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, comp) under the links found so far."""
    known = components(links).withColumnRenamed("id", "sid")
    return held(ids.join(known, "sid", "left").select("sid", F.coalesce("component_id", "sid").alias("comp")), "labels")


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents without those that are near copies of a document with a smaller doc_id (their group's first stays).

    Rows that repeat a doc_id stay together; rows without doc_id or words stay.
    """
    groups = jaccard_components(documents, words, percent).filter("doc_id > component_id").select("doc_id").distinct()
    return documents.join(groups, "doc_id", "left_anti")
