"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are encoded once. The ids are counted over all documents and replaced by their rank (0 is the most
frequent), so that most of them take one byte. Control bytes stand apart from the data: a control byte
holds the lengths (1 to 4 bytes) of four ranks, two bits each, lowest first. Decoding looks lengths and
masks up in numpy tables and does not branch on single values.

Files (all numbers little-endian):

* `ranks`: magic, number of ids (uint32), then the id (uint32) of each rank;
* `ids/part-*`: blocks one after the other, in ascending order of document ids over the files and inside
  them. A block is a header (HEADER: magic, documents, file number, ids of the file before it, bytes of
  control and data), document ids (int64), null marks (uint8), id counts (uint64), control bytes and data
  bytes. Each document starts at a control byte of its own.

A writer ends every record with a newline, which is part of the format. Spark's own writer and reader move
the files, so any store that Spark reaches will do, and a lost task is written again.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialspark.llm.common import by_id, held
from trialspark.operators.scan import ordered_scan, running_sum
from trialspark.session import scratch_path

MAGIC = b"FVB1"
HEADER = "<4sIIQQQ"
END = b"\n"

#: Length of each of the four ranks of a control byte, and the bits that a rank of each length has.
LENGTHS = np.array([[(control >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for control in range(256)], np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

#: About as many bytes has a file (a longer document makes a longer one), and as many ids a block.
FILE_BYTES = 16 << 20
BLOCK_IDS = 1 << 18
#: About as many bytes of text are encoded at once.
PIECE = 1 << 22


def _slots(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each id among the slots of the control bytes, and the number of slots."""
    wide = -(-counts // 4) * 4
    shift = (np.cumsum(wide) - wide) - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(counts.sum()), int(wide.sum())


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and data bytes of each document; `counts` are the ids of each document."""
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    at, slots = _slots(counts)
    codes = np.zeros(slots, np.uint8)
    codes[at] = more
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    wide = int(more.max(initial=0)) + 1
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide][np.arange(wide) <= more[:, None]]
    ends = np.concatenate([[0], np.cumsum(more.astype(np.int64) + 1)])
    stops = np.cumsum(counts)
    return control, data, ends[stops] - ends[stops - counts]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of all documents of a block."""
    at, _ = _slots(counts)
    lengths = LENGTHS[control].ravel()[at]
    starts = np.cumsum(lengths) - lengths
    whole = data.tobytes() + bytes(4)
    words = np.ndarray((len(data) + 1,), "<u4", whole, strides=(1,))  # the four bytes from each byte on
    return words[starts] & MASKS[lengths]


class Encoder:
    """The tokenizers library over batches of whole texts, with the ids of short pieces remembered.

    A byte-level pre-token takes a space in at its start only and never joins letters with punctuation, so that a text
    may be cut before a space or newline that follows a printable ASCII character, and before punctuation that
    follows a-z: the pieces encode like the whole. Pieces repeat, so the library sees each of a batch once.
    Tokenizers of another kind get whole texts.
    """

    CUTS = (r"([!-~])([ \n])", r"([a-z])([,.;:!?)\"])")
    #: Class of each byte, two bits of what may stand before a cut and two of what may follow it.
    CLASSES = np.array([("!" <= chr(b) <= "~") + 2 * ("a" <= chr(b) <= "z") + 4 * (chr(b) in " \n") + 8 * (chr(b) in ",.;:!?)\"") for b in range(256)], np.uint8)
    #: Pieces that a worker remembers, and their greatest length.
    REMEMBERED, SHORT = 1 << 20, 48

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules.get("pre_tokenizer") or {}
        self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                     and not any(rules.get(k) for k in ("normalizer", "truncation", "padding"))
                     and not any(t["lstrip"] or t["rstrip"] or re.search("|".join(self.CUTS), t["content"]) for t in rules["added_tokens"]))
        self.known: dict[str, bytes] = {}

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts one after the other, and how many each text has."""
        if not self.cuts:
            return texts, np.ones(len(texts), np.int64)
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        kind = np.append(self.CLASSES[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]] if data else np.zeros(0, np.uint8), np.uint8(0))
        kind[1:] = kind[:-1] & (kind[1:] >> 2)
        kind[ends - ends[0]] = 0  # a text's own start is no cut
        cut = np.flatnonzero(kind) + ends[0]
        first = np.searchsorted(cut, ends)
        upto = np.sort(np.concatenate([ends, cut]), kind="stable")
        return pa.LargeStringArray.from_buffers(len(upto) - 1, pa.py_buffer(upto), data), np.diff(first) + 1

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        cut, parts = self._pieces(texts)
        codes = cut.dictionary_encode()
        pieces = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            for i, e in zip(some, self.batch([pieces[i] for i in some], add_special_tokens=False)):
                found[i] = array("I", e.ids).tobytes()
                if len(self.known) < self.REMEMBERED and len(pieces[i]) <= self.SHORT:
                    self.known[pieces[i]] = found[i]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table, start = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        place = codes.indices.to_numpy()
        sizes = size[place]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        whole = table[np.repeat(start[place] - upto[:-1], sizes) + np.arange(upto[-1])]
        ends = np.concatenate([[0], np.cumsum(parts)])
        return whole, np.diff(upto[ends])


#: Of the worker: it outlives a task.
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(texts: pa.Array, size: int = PIECE) -> Iterator[pa.Array]:
    """Parts of about `size` bytes; one text may be longer."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size)))
        yield texts.slice(at, stop - at)
        at = stop


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, place, n, wide, ids): place tells rows of one doc_id apart, ids are uint32 (uint16 where not wide).

    Each task adds one row of place -1: how often each id occurs in it (pairs of uint64).
    """
    fields = [("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())]
    names = [name for name, _ in fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trialspark.llm.tokenfile import encoder

        model, place = encoder(tokenizer), TaskContext.get().partitionId() << 40
        total = np.zeros(0, np.int64)
        for batch in batches:
            texts, at = pc.fill_null(batch.column(1).cast(pa.large_string()), ""), 0
            for part in _slices(texts):
                ids, counts = model.ids(part)
                whole = np.empty(len(ids) + len(part), np.uint32)
                ends = np.cumsum(counts + 1) - 1
                keep = np.ones(len(whole), bool)
                keep[ends] = False
                whole[keep], whole[ends] = ids, end_id
                total = _added(total, np.bincount(whole))
                wide = bool(whole.max(initial=0) > 0xFFFF)
                data = _binary(whole.astype("<u4" if wide else "<u2").view(np.uint8), (counts + 1) * (4 if wide else 2))
                cols = [batch.column(0).slice(at, len(part)), pa.array(np.arange(place, place + len(part))), pa.array(counts + 1), pa.array([wide] * len(part)), data]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at, place = at + len(part), place + len(part)
        used = np.flatnonzero(total)
        if len(used):
            pairs = np.stack([used, total[used]], axis=1).astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((None, -1, 0, False, pairs), fields)], names=names)

    return docs.mapInArrow(rows, "doc_id long, place long, n long, wide boolean, ids binary")


def _ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for wide, ids in zip(batch.column("wide").to_pylist(), batch.column("ids")):
        yield np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two counts of different length."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs over all documents, from the counts of the tasks that encoded them."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                both = np.frombuffer(counts.as_buffer(), "<u8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "n"])

    return encoded.filter("place < 0").select("ids").mapInArrow(pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks(rows: DataFrame, rank) -> DataFrame:
    """Blocks of sorted partitions, one file each; rank: broadcast rank of each id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0

        def block(docs: pa.Array, counts: np.ndarray, ids: list[np.ndarray]) -> pa.RecordBatch:
            control, data, _ = pack(rank.value[np.concatenate(ids)], counts)
            nulls = docs.is_null().to_numpy(zero_copy_only=False)
            body = [struct.pack(HEADER, MAGIC, len(docs), part, before, len(control), len(data)), docs.fill_null(0).to_numpy().astype("<i8").tobytes(),
                    nulls.astype(np.uint8).tobytes(), counts.astype("<u8").tobytes(), control.tobytes(), data.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([b"".join(body)], pa.binary())], names=["block"])

        for batch in batches:
            counts, ids = batch.column("n").to_numpy(), list(_ids_of(batch))
            upto, at = np.cumsum(counts), 0
            while at < len(ids):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_IDS)))
                yield block(batch.column("doc_id").slice(at, stop - at), counts[at:stop], ids[at:stop])
                before += int(counts[at:stop].sum())
                at = stop

    return rows.mapInArrow(run, "block binary")


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every document, each followed by `end_id`, as files below `path`.

    tokenizer: file of the tokenizers library. Null and empty texts have the end id alone; rows that repeat a
    doc_id stay rows of their own, next to each other; rows with a null doc_id come first; an empty table
    gives an empty rank table and no block. Texts of any length are encoded whole. Other columns are ignored.
    """
    spark = documents.sparkSession
    encoded = held(_encoded(by_id(documents, id_col, text_col), tokenizer, end_id), "token-ids", compression="zstd")
    tokens = encoded.filter("place >= 0")
    counts = sorted(((r.n, r.id) for r in id_counts(encoded).collect()), key=lambda x: (-x[0], x[1]))  # a vocabulary at most
    order = np.array([i for _, i in counts], np.uint32)
    total = sum(n for n, _ in counts)
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    files = max(1, -(-(total + total // 2) // file_bytes))
    rows = tokens.repartitionByRange(files, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    _write(_blocks(rows, shared), path + "/ids")
    table = MAGIC + struct.pack("<I", len(order)) + order.astype("<u4").tobytes()
    _write(spark.createDataFrame([(table,)], "block binary").coalesce(1), path + "/ranks")


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _write(blocks: DataFrame, path: str) -> None:
    # a cast keeps the bytes as they are, and the writer puts them out unchanged
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


def blocks_of(content: bytes) -> Iterator[tuple]:
    """(file number, ids before, document ids, null marks, counts, control, data) of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, part, before, n_control, n_data = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += struct.calcsize(HEADER)
        fields = []
        for kind, size in (("<i8", docs), ("u1", docs), ("<u8", docs), ("u1", n_control), ("u1", n_data)):
            fields.append(np.frombuffer(content, kind, size, at))
            at += fields[-1].nbytes
        if content[at:at + 1] != END:
            raise ValueError(f"the block before byte {at} does not end there")
        at += 1
        yield part, before, *fields


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """Id of each rank."""
    content = spark.read.format("binaryFile").load(path + "/ranks").select("content").first()[0]
    (n,) = struct.unpack_from("<I", content, len(MAGIC))
    return np.frombuffer(content, "<u4", n, len(MAGIC) + 4)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids_crc32[, token_ids]) of every document of the files below `path`.

    start counts the ids of all documents before it in its file (`part`) - see starts() for all files;
    ids_crc32 is the checksum of the decoded ids as little-endian 32-bit numbers.
    """
    shared = spark.sparkContext.broadcast(read_ranks(spark, path))
    fields = [("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("token_ids", pa.list_(pa.int64()))]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for content in batch.column(0):
                for part, before, docs, nulls, counts, control, data in blocks_of(content.as_py()):
                    counts = counts.astype(np.int64)
                    ids = table[unpack(control, data, counts)]
                    stops = np.cumsum(counts)
                    whole = memoryview(ids.tobytes())
                    sums = [zlib.crc32(whole[4 * (b - n):4 * b]) for b, n in zip(stops.tolist(), counts.tolist())]
                    cols = [pa.array(docs, mask=nulls.astype(bool)), pa.array(np.full(len(docs), part, np.int64)), pa.array(before + stops - counts), pa.array(counts), pa.array(sums, pa.int64())]
                    if with_ids:
                        ends = np.concatenate([[0], stops]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    names = "doc_id long, part long, start long, n_tokens long, ids_crc32 long" + (", token_ids array<long>" if with_ids else "")
    return spark.read.format("binaryFile").load(path + "/ids").select("content").mapInArrow(run, names)


def starts(tokens: DataFrame) -> DataFrame:
    """read_tokens() with `start` counted over all files: each file gets the sum of those before it."""
    sizes = held(tokens.groupBy("part").agg(F.sum("n_tokens").alias("ids")), "file-sizes")
    sizes = sizes.withColumn("one", F.lit(0))
    carry = ordered_scan(sizes, ["one"], ["part"], F.floor(F.col("part") / 4096).cast("bigint"), upto=running_sum(F.col("ids")))
    carry = carry.select("part", (F.col("upto") - F.col("ids")).alias("before"))
    carry = F.broadcast(carry) if sizes.count() <= 100_000 else carry
    return tokens.join(carry, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def tokens_on_disk(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the documents to fresh files in the shared folder and describe what these hold."""
    spark = documents.sparkSession
    path = scratch_path(spark, "llm-token-files")
    write_tokens(documents, path, tokenizer, end_id)
    return starts(held(read_tokens(spark, path, with_ids=False), "read-back"))
