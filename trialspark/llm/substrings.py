"""Substring dedup by seed and extend.

Seeds are word k-grams picked by winnowing: every window of `length` words holds the least k-gram hash
of its own words, so two equal windows share the same seed at the same place. Documents are joined on
seeds and every match is extended both ways, up to the window length on each side:

* extension in bulk: occurrences of a seed with the same words all around it (as far as a window
  reaches) are one class; all windows through the seed are equal, so that all but the class's first
  document are settled by one comparison;
* extension word by word: where a seed occurs in different surroundings, the first document of each
  class extends it window by window and looks for the same window in a smaller document. The first
  document that has a window is the first of its class, so nothing is missed.

The matched windows, merged, are the maximal repeats. No pairs of documents are made, so a passage that
very many documents share costs as much as its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import RangeHash, by_id, held, in_chunks, near_semi, text_rows, word_hashes, words_of

#: Words in a seed.
SEED = 16


class Seeds:
    """Winnowed seeds of texts, for windows of `length` words."""

    def __init__(self, length: int):
        self.length, self.k = length, min(SEED, length)
        self.reach = length - self.k  # words of a window besides its seed
        self.ranges = RangeHash()

    def sums(self, text: bytes) -> np.ndarray:
        return self.ranges.sums(word_hashes(text))

    def chosen(self, sums: np.ndarray) -> np.ndarray:
        """Position of the seed of each window: of its leftmost least k-gram."""
        left = np.arange(len(sums) - self.k)
        grams = self.ranges.ranges(sums, left, left + self.k)
        windows = np.lib.stride_tricks.sliding_window_view(grams, self.reach + 1)
        return windows.argmin(axis=1) + np.arange(len(windows))

    def around(self, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each seed, and of all words that its windows reach."""
        n = len(sums) - 1
        seed = self.ranges.ranges(sums, at, at + self.k)
        wide = self.ranges.ranges(sums, np.maximum(at - self.reach, 0), np.minimum(at + self.length, n))
        return seed, wide ^ (np.minimum(at, self.reach).astype(np.uint64) << np.uint64(32))

    def windows(self, sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.ranges.ranges(sums, starts, starts + self.length)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _seeds(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_words, sha256, seed, wide, pos): hash of the words of each document, and its seeds."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("seed", longs), ("wide", longs), ("pos", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seeds, none = Seeds(length), np.empty(0, np.int64)
        for doc, text in text_rows(batches):
            words = words_of(text)
            digest = hashlib.sha256(b" ".join(words)).hexdigest()
            if len(words) < length:
                yield doc, len(words), digest, none, none, none
                continue
            sums = seeds.sums(text)
            at = np.unique(seeds.chosen(sums))
            seed, wide = seeds.around(sums, at)
            yield doc, len(words), digest, _signed(seed), _signed(wide), at

    return docs.mapInArrow(lambda b: in_chunks(rows(b), schema, 256), "doc_id long, n_words long, sha256 string, seed array<long>, wide array<long>, pos array<int>")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, hash, start) of the windows of documents whose seed is among the positions `at`."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.list_(pa.int64())), ("start", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seeds = Seeds(length)
        for batch in batches:
            for (doc, text), at in zip(text_rows([batch]), batch.column(2).to_pylist()):
                sums = seeds.sums(text)
                if len(sums) <= length:
                    continue
                starts = np.flatnonzero(np.isin(seeds.chosen(sums), np.array(at)))
                yield doc, _signed(seeds.windows(sums, starts)), starts.astype(np.int32)

    out = docs.select("doc_id", "text", "at").mapInArrow(lambda b: in_chunks(rows(b), schema, 256), "doc_id long, hash array<long>, start array<int>")
    return out.select("doc_id", F.explode(F.arrays_zip("hash", "start")).alias("w")).select("doc_id", "w.hash", "w.start")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, kept, n_words, n_removed): words of documents without the windows that start in `spans`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for (doc, text), spans in zip(text_rows([batch]), batch.column(2)):
                words = words_of(text)
                n = len(words)
                lo, hi = (spans.values.field(i).to_numpy() for i in (0, 1))
                mark = np.zeros(n + 1, np.int64)
                lo, hi = np.maximum(lo, 0), np.minimum(hi, n - length)  # first and last start of a window
                ok = lo <= hi
                np.add.at(mark, lo[ok], 1)
                np.add.at(mark, hi[ok] + length, -1)
                gone = np.cumsum(mark[:n]) > 0
                yield doc, n, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()

    return docs.select("doc_id", "text", "spans").mapInArrow(lambda b: in_chunks(rows(b), schema, 256), "doc_id long, n_words long, n_removed long, kept string")


def _found(documents: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their seeds, and per document the starts of windows that a smaller document has."""
    docs = by_id(documents, id_col, text_col)
    table = held(_seeds(docs, length), "seeds")
    keyed = table.filter(f"doc_id IS NOT NULL AND n_words >= {length}")
    # a copy of a whole document: every window starts in the first of them too
    first = keyed.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha256", "first")
    copies = held(keyed.select("doc_id", "sha256", "n_words").join(first, "sha256").filter("doc_id > first").select("doc_id", "sha256", "n_words"), "copies")
    seeds = keyed.join(copies.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti").select("doc_id", F.explode(F.arrays_zip("seed", "wide", "pos")).alias("s")).select("doc_id", "s.seed", "s.wide", "s.pos")
    classes = seeds.groupBy("seed", "wide").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = classes.groupBy("seed").agg(F.min("first").alias("d0"), F.max("last").alias("d1"), F.min("wide").alias("w0"), F.max("wide").alias("w1")).filter("d0 < d1")
    classes = classes.join(shared.select("seed", F.expr("w0 < w1").alias("varied")), "seed").filter("varied OR first < last")
    hits = held(seeds.join(classes, ["seed", "wide"]).filter("doc_id > first OR varied").select("doc_id", "pos", F.expr("doc_id > first").alias("whole")), "hits")
    reach = length - min(SEED, length)
    spans = hits.filter("whole").select("doc_id", F.expr(f"pos - {reach}").alias("lo"), F.col("pos").alias("hi"))
    open_ = hits.filter("NOT whole").groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    open_ = held(open_, "open")
    text = near_semi(docs, "doc_id", open_, "doc_id").join(open_, "doc_id")
    windows = held(_windows(text, length), "windows")
    met = windows.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("hash", "first")
    again = windows.join(met, "hash").filter("doc_id > first").select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))
    spans = spans.unionByName(again).unionByName(copies.select("doc_id", F.lit(0).alias("lo"), (F.col("n_words") - length).cast("int").alias("hi")))
    spans = held(spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    return docs, table, spans


def remove_repeats(documents: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, sha256) of every document.

    Removed is each word covered by a window of `length` consecutive words that also starts in a document
    with a smaller doc_id; windows are judged on the input. `kept` joins what stays by one space and is
    null where nothing is removed (the text stays as it is); sha256 is the lowercase hex digest of the kept
    words joined by one space in either case. Null texts have no words. Rows with a null doc_id keep all
    words and remove none; rows that repeat a doc_id count as one document, and each loses what any of
    them loses at the same places. An empty table gives an empty table; other columns are ignored.
    """
    docs, table, spans = _found(documents, length, id_col, text_col)
    cut = held(_cut(near_semi(docs, "doc_id", spans, "doc_id").join(spans, "doc_id"), length), "cut")
    as_is = table.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"), "sha256")
    as_is = as_is.join(spans.select("doc_id"), "doc_id", "left_anti")
    return as_is.unionByName(cut.withColumn("sha256", F.sha2(F.col("kept").cast("binary"), 256)))
