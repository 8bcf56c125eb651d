"""Every query against SQL or brute force over the smallest tables."""

import base64
import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
from compare import compare, connect  # noqa: E402

from trialspark.llm import queries as Q  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


class Query:
    def __init__(self, name):
        self.frame, self.sql = Q.queries()[name], Q.oracle_sql()[name]

    def check_sql(self):
        return self.sql


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    got, want, note, _ = compare(spark, connect(FOLDER), Query(name), FOLDER)
    assert note == "ok" and got == want


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


def test_bpe(spark, texts):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in Q.op2_byte_bpe(spark, FOLDER).collect()} == want


def test_language(spark):
    import zlib

    rows = {r.doc_id: r for r in Q.op3_language_id(spark, FOLDER).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {i: r.held_out for i, r in rows.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].lang_pred == docs[i].lang for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_secrets(spark):
    rows = Q.op4_secret_scan(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    import re

    want = {(i, m.start(1)) for i, t in docs.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert {(r.doc_id, r.start) for r in rows if r.is_secret} == want
    for r in rows:
        assert r.candidate_sha256 == hashlib.sha256(docs[r.doc_id][r.start:r.start + r.length].encode()).hexdigest()


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op5_ngram_jaccard_join(spark, FOLDER).collect()}
    assert got == brute.jaccard(texts, 4, 85)


def test_substrings(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op7_substring_dedup(spark, FOLDER).collect()}
    assert got == brute.repeats(texts, 50)


def test_mix_is_stable(spark):
    runs = [sorted(map(tuple, Q.op8_source_mix(spark, FOLDER).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
