"""Hard negatives, conversation repair and token files against brute force, edge cases included."""

import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from trialspark.llm import negatives as N, queries as Q, repair as R, tokenfile as T  # noqa: E402
from trialspark.session import scratch_path  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def token_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_rows(rows):
    from tokenizers import Tokenizer

    model, out, at = Tokenizer.from_file(token_path()), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_token_files_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op13_token_files(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(r[:4] for r in token_rows(rows))


def test_token_files_edges(spark, docs):
    rows = [(5, "a b " * 90_000 + "\n \n " + "é ñ " * 90_000), (None, None), (3, ""), (9, "<|endoftext|> x"), (4, "\n\x00 a"), (7, None), (8, "x" * 3000)]
    path = scratch_path(spark, "tokens")
    T.write_tokens(docs(rows), path, token_path(), file_bytes=2000)
    back = T.starts(T.read_tokens(spark, path))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.token_ids) for r in back.collect()]
    assert sorted(got, key=str) == sorted(token_rows(rows), key=str)
    assert back.select("part").distinct().count() > 1


def test_pieces_are_cut_at_bytes():
    """Cuts come from the bytes alone: no separator is inserted that a text might hold, and no text's start is a cut."""
    import pyarrow as pa

    texts = ["", "ab, cd.", "é b\x00\x1f\x00c d", "", " x\n\ny", "!"]
    pieces, parts = T.Encoder(token_path())._pieces(pa.array(texts, pa.large_string()))
    assert pieces.to_pylist() == ["", "ab", ",", " cd", ".", "é b\x00\x1f\x00c", " d", "", " x", "\n\ny", "!"]
    assert parts.tolist() == [1, 4, 2, 1, 2, 1]
    pieces, parts = T.Encoder(token_path())._pieces(pa.array(texts, pa.large_string()).slice(1, 2))
    assert "".join(pieces.to_pylist()) == "".join(texts[1:3]) and parts.tolist() == [4, 2]


def test_token_files_repeats_and_none(spark, docs):
    path = scratch_path(spark, "tokens")
    T.write_tokens(docs([(1, "a"), (1, "a"), (1, "b c"), (0, None)]), path, token_path())
    got = sorted((r.doc_id, r.n_tokens) for r in T.read_tokens(spark, path).collect())
    assert got == [(0, 1), (1, 2), (1, 2), (1, 3)]
    path = scratch_path(spark, "tokens")
    T.write_tokens(docs([]), path, token_path())
    assert T.starts(T.read_tokens(spark, path)).collect() == []


def test_coding_round_trip():
    random.seed(3)
    for counts in ([1], [5, 1, 4, 3], [0, 2, 0]):
        ranks = np.array([random.choice([0, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1]) for _ in range(sum(counts))], np.uint32)
        control, data, sizes = T.pack(ranks, np.array(counts))
        assert sizes.sum() == len(data)
        assert (T.unpack(control, data, np.array(counts)) == ranks).all()


def test_pieces_encode_like_the_whole():
    import pyarrow as pa
    from tokenizers import Tokenizer

    random.seed(4)
    parts = ["ab", "é", "ñandú", " ", "  ", "\n", " \n", "\n\n ", "\t", "\u00a0", "\u3000", ".", ",", "...", "!?", "'s", "'", "don't", "12", "a1", "<|endoftext|>", "\x00", "\x00\x1f\x00", "日本", "x" * 60, ")\"", "e\u0301", "_"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(12))) for _ in range(3000)]
    model = Tokenizer.from_file(token_path())
    encoder = T.Encoder(token_path())
    assert encoder.cuts
    for some in ([t for t in texts if "\x1f" not in t], texts):
        ids, counts = encoder.ids(pa.array(some, pa.large_string()))
        want = [e.ids for e in model.encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "m", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int")


def reports(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reports(Q.op12_conversation_repair(spark, FOLDER)) == brute.repair(rows)


@pytest.mark.parametrize("chunk, fan", [(4096, 4096), (4, 3), (1, 2)])
def test_repair_cut_into_segments(spark, chunk, fan):
    random.seed(1)
    roles = ["user", "assistant", "system", "tool", None, ""]

    def some(n, conv):
        return [(conv, random.choice([None, i, i, i]), random.choice(roles[:3] if random.random() < 0.8 else roles),
                 random.choice(["a.", "b", "c!", " ", None, "d?\n", f"x {random.randrange(100)}."])) for i in range(n)]

    rows = some(120, None) + some(200, 7) + [r for c in range(20, 50) for r in some(random.randrange(1, 12), c)]
    rows += [(60, 0, "user", "long " * 50_000 + "."), (60, 1, "assistant", "ok.")]
    assert reports(R.repair_report(conversations(spark, rows), chunk, fan)) == brute.repair(rows)


def test_repair_nothing_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = R.repair_report(conversations(spark, [(dropped, 0, "user", "a.")])).first()
    assert tuple(found)[1:8] == (0, 0, 0, 0, 0, 0, "") and found.repaired_sha256.startswith("e3b0c44298fc")
    assert R.repair_report(conversations(spark, [])).collect() == []


def mined(rows, every):
    own = [(i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows
           if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (anchor, vec, label) in enumerate(own):
        if anchor % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vec, v)), i, other == label) for m, (i, v, other) in enumerate(own) if m != n and len(v) == len(vec))
        for score, i, _ in [s for s in scores if s[2]][:5]:
            found = [s for s in scores if not s[2] and -30 * score <= -100 * s[0] <= -90 * score][:10]
            out += [(anchor, i, rank, j, -score, -s) for rank, (s, j, _) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_hard_negatives(spark, block):
    random.seed(2)
    rows = [(i, [random.choice([-1.0, 0.0, 0.01, 0.5, 1.0]) for _ in range(random.choice([2, 2, 3]))], random.choice([None, 0, 1, 2])) for i in range(300)]
    rows += [(100, [1.0, 1.0], 1)] * 2 + [(None, [1.0, 1.0], 1), (500, None, 1), (600, [float("nan"), 1.0], 1), (700, [], 1), (800, [None, 1.0], 1), (900, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, score int")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert sorted(map(tuple, N.mine(df, F.col("vec_id") % 20 == 0, moved, block_components=block).collect())) == mined(rows, 20)
    assert N.mine(df.limit(0), F.col("vec_id") % 20 == 0, moved).collect() == []


def test_hard_negatives_large_scores(spark):
    rows = [(0, [1.1e5, -3e4], 0), (1, [9e4, 1.0], 0), (2, [7e4, 5.0], 1), (3, [8e4, -1e4], 2), (100, [-2e5, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, N.mine(df, F.col("vec_id") % 100 == 0, F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")).collect())) == mined(rows, 100)
