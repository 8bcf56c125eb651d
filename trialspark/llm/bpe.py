"""Byte-level BPE with a sentencepiece model that is written straight from a rank vocabulary.

Each byte becomes one character, each vocabulary entry a piece of such characters with score minus its
rank, and the normaliser is the identity. The sentencepiece BPE then joins the pair of least rank first,
as byte-level BPE asks. Texts are split into pre-tokens, each pre-token is encoded by itself, and ids are
decoded by mapping the characters of their pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Field numbers and types of the serialised sentencepiece model.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, TYPE_UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, MODEL_TYPE_BPE, VOCAB_SIZE = 3, 2, 4
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5

#: Characters of bytes: byte b is FIRST_CHAR + b, letters that no rule of sentencepiece treats specially.
FIRST_CHAR = 0x100
BYTE_CHARS = [chr(FIRST_CHAR + b) for b in range(256)]

#: Pre-tokens whose ids a worker remembers (frequent ones come early), and their greatest length.
REMEMBERED, LONGEST = 1 << 19, 64


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each byte string, from a file of base64 text and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, file)}


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: the unknown piece, then the vocabulary by rank."""
    def piece(text: str, score: float) -> bytes:
        return _block(PIECE_TEXT, text.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)

    out = [_block(PIECES, piece("<unk>", 0.0) + _number(PIECE_TYPE, TYPE_UNKNOWN))]
    out += [_block(PIECES, piece("".join(BYTE_CHARS[b] for b in text), -float(rank))) for text, rank in sorted(ranks.items(), key=lambda x: x[1])]
    out.append(_block(TRAINER, _number(MODEL_TYPE, MODEL_TYPE_BPE) + _number(VOCAB_SIZE, len(ranks) + 1)))
    out.append(_block(NORMALIZER, _block(NORMALIZER_NAME, b"identity") + _number(ADD_DUMMY_PREFIX, 0) + _number(REMOVE_EXTRA_WHITESPACES, 0) + _number(ESCAPE_WHITESPACES, 0)))
    return b"".join(out)


#: A character of each class that stands for others of it when a text is split; none is special in a pattern.
STAND_INS = {"L": "b", "N": "0", "other": "!"}


def moved_characters(ranks: dict[bytes, int]) -> dict[int, str]:
    """Characters that this regex module classes otherwise than the tokenizer library, with a stand-in each.

    Both know letters and numbers of some Unicode version; the library's counts. All code points are run
    through one pattern for each class, so the table follows the installed versions.
    """
    import regex
    import tiktoken

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    there, here = {}, {}
    for kind in ("L", "N"):
        pattern = rf"\p{{{kind}}}+"
        plain = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        there |= dict.fromkeys(plain.decode(plain.encode_ordinary(points)), kind)
        here |= dict.fromkeys("".join(regex.findall(pattern, points)), kind)
    return {ord(c): STAND_INS[there.get(c, "other")] for c in there.keys() | here.keys() if there.get(c) != here.get(c)}


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes, ids: np.ndarray, pattern: str, moved: dict[int, str]):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = ids  # id of each piece after the unknown one
        self.split = regex.compile(pattern).findall
        self.moved = moved
        self.is_moved = np.zeros(0x110000, bool)
        self.is_moved[list(moved)] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> dict[str, bytes]:
        out = {}
        mapped = ["".join([BYTE_CHARS[b] for b in t.encode()]) for t in tokens]
        for token, text, found in zip(tokens, mapped, self.model.encode(mapped, out_type=int)):
            whole = self.model.piece_to_id(text)
            out[token] = self.ids[whole - 1].tobytes() if whole else self.ids[np.array(found, np.int64) - 1].tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit numbers."""
        if not text:
            return b""
        if self.moved and not text.isascii() and self.is_moved[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            # split with stand-ins of one character each, then take the text itself
            ends = np.cumsum([0, *map(len, self.split(text.translate(self.moved)))]).tolist()
            tokens = [text[a:b] for a, b in zip(ends, ends[1:])]
        else:
            tokens = self.split(text)
        known = self.known
        found = list(map(known.get, tokens))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = list(dict.fromkeys([tokens[i] for i in missing]))
            learnt: dict[str, bytes] = {}
            for at in range(0, len(new), 4096):
                learnt |= self._learn(new[at:at + 4096])
            for i in missing:
                found[i] = learnt[tokens[i]]
            for token in new[: max(0, REMEMBERED - len(known))]:
                if len(token) <= LONGEST:
                    known[token] = learnt[token]
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))

    @cached_property
    def vocabulary(self) -> dict[int, bytes]:
        pieces = (self.model.id_to_piece(i + 1) for i in range(len(self.ids)))
        return {int(i): bytes(ord(c) - FIRST_CHAR for c in p) for i, p in zip(self.ids, pieces)}


#: The codec of the worker: it outlives a task, with what it remembers. Another tokenizer takes its place.
_codecs: dict[str, Codec] = {}


def codec_of(key: str, model: Broadcast) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*model.value)
    return _codecs[key]


def release_codecs() -> None:
    """Let the worker's tokenizer go, and give memory that is no longer used back to the system."""
    _codecs.clear()
    pa.default_memory_pool().release_unused()


class ByteBPE:
    """Byte-level BPE as column functions.

    path: file of base64 byte strings and ranks, read by the driver; the model is broadcast, its size is
    that of the vocabulary. pattern: how a text is split before merging (no special tokens).
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        ids = np.array(sorted(ranks.values()), np.int32)
        parts = (serialize_model(ranks), ids, pattern, moved_characters(ranks))
        self._key = hashlib.sha256(parts[0] + pattern.encode()).hexdigest()
        self._model = spark.sparkContext.broadcast(parts)

    def encode(self, text: Column) -> Column:
        """Ids (array of int) of a text; null and empty texts have none."""
        key, model = self._key, self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from trialspark.llm.bpe import codec_of

            codec = codec_of(key, model)
            for texts in batches:
                parts = [codec.encode(t.as_py()) for t in texts]
                ends = np.cumsum([0, *map(len, parts)]) // 4
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids; null where the array is null. An id without a piece is an error."""
        key, model = self._key, self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from trialspark.llm.bpe import codec_of

            codec = codec_of(key, model)
            for lists in batches:
                yield pa.array([codec.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists], pa.binary())

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "binary")(ids)

    def round_trip(self, text: Column, keep: bool = True) -> Column:
        """Ids of a text and the bytes that they decode to, as a struct.

        One worker does both, so that ids are not sent to a second one, which would hold the tokenizer again.
        keep: the worker keeps the tokenizer and what it remembers for its next task; else a task lets both go,
        for jobs in which other operators use the same workers.
        """
        key, model = self._key, self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from trialspark.llm.bpe import codec_of, release_codecs

            codec = codec_of(key, model)
            for texts in batches:
                parts = [codec.encode(t.as_py()) for t in texts]
                decoded = pa.array([codec.decode(np.frombuffer(p, np.int32)) for p in parts], pa.binary())
                ends = pa.array(np.cumsum([0, *map(len, parts)]) // 4, pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(parts), np.int32)))
                del parts
                yield pa.StructArray.from_arrays([ids, decoded], names=["token_ids", "decoded"])
            if not keep:
                del codec
                release_codecs()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "token_ids array<int>, decoded binary")(text)


def encode_documents(documents: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Documents with their ids in a new column; a column of that name is replaced, all others stay.

    Null and empty texts get an empty array; an empty table stays empty; texts of any length are encoded
    whole. The text itself stays, so that ids can be held against it.
    """
    return documents.withColumn(out_col, ByteBPE(documents.sparkSession, path, pattern).encode(F.col(text_col).cast("string")))


def decode_documents(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Tables of ids with their decoded bytes in a new column (null for null ids)."""
    return tokens.withColumn(out_col, ByteBPE(tokens.sparkSession, path, pattern).decode(F.col(ids_col)))


def round_trip_documents(documents: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded", keep: bool = True) -> DataFrame:
    """Documents with their ids and the bytes these decode to: encode_documents and decode_documents in one step.

    Columns of these two names are replaced, all others stay. Null and empty texts have an empty array and no bytes.
    keep: see ByteBPE.round_trip.
    """
    both = ByteBPE(documents.sparkSession, path, pattern).round_trip(F.col(text_col).cast("string"), keep)
    found = documents.withColumn("__both", both)
    return found.withColumns({ids_col: F.col("__both.token_ids"), out_col: F.col("__both.decoded")}).drop("__both")
