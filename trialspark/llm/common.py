"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialspark.session import materialize, scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text: runs of characters other than ASCII white space. None has none."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RangeHash:
    """Hashes of word ranges: two polynomials of the word hashes, each modulo the prime 2**31 - 1.

    The hash of words [l, r) comes from two prefix sums, whatever the length of the range. The bases are primitive
    roots, so that no power of one repeats within a text and no arrangement of words is special.
    """

    PRIME = np.uint64((1 << 31) - 1)
    BASES = (7, 48271)  # primitive roots of the prime

    def __init__(self) -> None:
        self.up = self.down = np.ones((1, 2), np.uint64)

    def _powers(self, bases: list[int], n: int) -> np.ndarray:
        out = np.ones((1, 2), np.uint64)
        while len(out) < n:
            step = np.array([pow(b, len(out), int(self.PRIME)) for b in bases], np.uint64)
            out = np.concatenate([out, out * step % self.PRIME])
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(values):
            self.up = self._powers(list(self.BASES), len(values) + 1)
            self.down = self._powers([pow(b, -1, int(self.PRIME)) for b in self.BASES], len(values) + 1)
        halves = values.astype("<u8", copy=False).view("<u4").reshape(-1, 2).astype(np.uint64) % self.PRIME
        out = np.zeros((len(values) + 1, 2), np.uint64)
        np.cumsum(halves * self.up[: len(values)] % self.PRIME, axis=0, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        both = (sums[right] - sums[left]) % self.PRIME * self.down[left] % self.PRIME
        return mix((both[:, 0] << np.uint64(31) | both[:, 1]) + ((right - left).astype(np.uint64) << np.uint64(62)))


class WordHashes(dict):
    """64-bit hash of each word by a strong hash function; a bounded number of words is remembered."""

    REMEMBERED = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.REMEMBERED:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_word_hashes = WordHashes()


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word of a text, in order; with `lower`, A-Z count as a-z."""
    words = (text.lower() if lower else text).split()
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(id, UTF-8 bytes) of each row of batches whose columns are an id and a text; null is empty."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for key, text in zip(batch.column(0).to_pylist(), texts):
            yield key, text.as_py() or b""


def in_chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from a stream of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(col), type=field.type) for col, field in zip(zip(*rows), schema)], schema=schema)


BUCKETS = 1 << 18


def near_semi(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of df whose key may be in ids: all that are, and a few that share a hash bucket.

    Only bucket numbers are broadcast, at most 2**18 of them whatever the data, so a wide table
    is thinned before it is shuffled. An exact join has to follow.
    """
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(11)), F.lit(BUCKETS)).cast("int")
    seen = ids.select(bucket(id_column).alias("__bucket")).distinct()
    return df.withColumn("__bucket", bucket(column)).join(F.broadcast(seen), "__bucket", "left_semi").drop("__bucket")


def by_id(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hash_sample(df: DataFrame, group: str, per_group: int, *key: str) -> DataFrame:
    """About four times per_group rows of each group, or all of a small one: those whose key has a low hash.

    The share of a group comes from its count, so no group is gathered to cut it; an exact limit may follow.
    """
    counts = held(df.groupBy(group).agg(F.count("*").alias("__n")).withColumnRenamed(group, "__group"), "group-counts")
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    place = F.pmod(F.xxhash64(*[F.col(c) for c in key], F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    low = place * F.col("__n") < 4.0 * per_group
    return df.join(counts, F.col(group) == F.col("__group")).filter(low).drop("__group", "__n")


def held(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a table in the shared scratch folder; options are those of the Parquet writer."""
    if not options:
        return materialize(df, "llm-" + label)
    path = scratch_path(df.sparkSession, "llm-" + label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
