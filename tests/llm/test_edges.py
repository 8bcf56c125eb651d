"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from trialspark.llm import fixity, jaccard, secrets  # noqa: E402
from trialspark.llm.bpe import decode_documents, encode_documents, round_trip_documents  # noqa: E402
from trialspark.llm.components import components  # noqa: E402
from trialspark.llm.jaccard import jaccard_components, keep_one  # noqa: E402
from trialspark.llm.language import fit, identify, is_held_out, predict  # noqa: E402
from trialspark.llm.lines import drop_boilerplate, url_host  # noqa: E402
from trialspark.llm.mixing import mix, numbered, take_mix, targets  # noqa: E402
from trialspark.llm.neardup import keep_representatives, near_duplicates  # noqa: E402
from trialspark.llm.queries import _tokenizer  # noqa: E402
from trialspark.llm.substrings import remove_repeats  # noqa: E402
from trialspark.llm.topk import top_k  # noqa: E402


def text_of(seed, n, vocabulary=500):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


BASE = text_of(1, 120)
#: Near copies at many distances, exact copies, case and blank variants, short, empty and null texts.
FAMILY = ([(i, edited(BASE, i, 0.002 * i)) for i in range(40)] + [(100 + i, BASE) for i in range(5)]
          + [(200, BASE.upper()), (201, BASE.replace(" ", "\t \n")), (202, "one two"), (203, "One  TWO"), (204, ""), (205, None), (206, " \t"), (207, "one two three"), (208, text_of(9, 30000))]
          + [(300 + i, text_of(50 + i, 60) + " " + text_of(77, 80) + " " + text_of(90 + i, 60)) for i in range(12)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100), (200, 300), (None, 5), (50, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 200: 200, 300: 200, 50: 0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_family(spark, docs, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(FAMILY), k, percent).collect()}
    assert got == brute.jaccard(FAMILY, k, percent)


def test_shingles_are_counted_in_bunches():
    """A task holds a bounded number of shingles, however many texts its batch has."""
    sizes = [0, 5, jaccard.COUNTED, 3, *[1000] * 300, 0]
    bunches = list(jaccard._bunches(np.full(n, i, np.uint64) for i, n in enumerate(sizes)))
    assert max(map(len, bunches)) < jaccard.COUNTED + max(sizes) and len(bunches) > 2
    assert np.bincount(np.concatenate(bunches).astype(int), minlength=len(sizes)).tolist() == sizes


def test_jaccard_repeats_and_nulls(spark, docs):
    got = jaccard_components(docs([(1, BASE), (1, BASE), (None, BASE), (2, edited(BASE, 5, 0.01)), (3, None)]), 4, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert jaccard_components(docs([(1, "x")]).limit(0)).count() == 0
    kept = keep_one(docs([(4, BASE), (4, BASE), (9, BASE), (5, ""), (None, BASE)]))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 5]
    assert kept.columns == docs([(1, "")]).columns


@pytest.mark.parametrize("length", [50, 20, 8])
def test_substring_family(spark, docs, length):
    got = remove_repeats(docs(FAMILY), length).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha256) for r in got} == brute.repeats(FAMILY, length)
    assert all(r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.sha256 for r in got)


def test_substring_repetitive(spark, docs):
    rows = [(1, "a b " * 100), (2, "a " * 200), (3, "a b " * 40 + "c"), (4, "a " * 60), (5, "b a " * 30), (6, "a " * 49)]
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha256) for r in remove_repeats(docs(rows)).collect()} == brute.repeats(rows, 50)
    got = remove_repeats(docs([(None, BASE), (1, BASE), (2, BASE), (2, BASE)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 120), (2, 120)]
    assert remove_repeats(docs([(1, "")]).limit(0)).count() == 0


def test_bpe_without_kept_tokenizer_gives_the_same(spark):
    from trialspark.llm import bpe

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Some words, some 12345.", "", None, "naïve \u00df 漢字 words words"] * 5)], "doc_id long, text string").repartition(3)
    tokenizer = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    kept, let_go = ({r.doc_id: (r.token_ids, bytes(r.decoded)) for r in bpe.round_trip_documents(rows, keep=k, **tokenizer).collect()} for k in (True, False))
    assert kept == let_go and all(bytes_ == (t or "").encode() for (_, bytes_), t in zip([kept[r] for r in range(20)], ["Some words, some 12345.", "", None, "naïve \u00df 漢字 words words"] * 5))


def test_bpe_against_library(spark, docs):
    import base64

    import tiktoken

    settings = _tokenizer()
    with open(settings["path"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=settings["pattern"], mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(3)
    texts = [None, "", " ", "  a", "a  b c", "\x1c\x1d\x1e\x1f\x85", "▁▁x", "<unk><s></s>", "it's we'll I'M", "x" * 50_000, "퟿", "\u0000a"]
    texts += ["".join(chr(r.choice(points)) for _ in range(300)) for _ in range(40)]
    texts += ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}" for c in points[i:i + 5000]) for i in range(0, len(points), 5000)]
    rows = list(enumerate(texts))
    out = decode_documents(encode_documents(docs(rows).repartition(8), **settings), **settings).collect()
    assert len(out) == len(rows)
    wrong = [x.doc_id for x in out if x.token_ids != plain.encode_ordinary(texts[x.doc_id] or "") or bytes(x.decoded) != (texts[x.doc_id] or "").encode()]
    assert not wrong
    whole = {x.doc_id: x for x in round_trip_documents(docs(rows).repartition(8), **settings).collect()}
    assert whole == {x.doc_id: x for x in out}
    for step in (encode_documents, round_trip_documents):
        assert step(docs([(1, "a")]).limit(0), **settings).count() == 0


def test_language_cases(spark, docs):
    rows = [(i, "der und die nicht ein " * 3 if i % 2 else "the of and to in is") for i in range(40)]
    table = docs(rows).withColumn("lang", F.expr("CASE WHEN doc_id % 2 = 1 THEN 'de' WHEN doc_id = 4 THEN NULL ELSE 'en' END")).withColumn("score", F.lit("old"))
    more = docs([(100, None), (101, "123 !"), (102, ""), (103, "�der und " * 20000), (None, "the of")]).withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("old"))
    out = {r.doc_id: r for r in identify(table.unionByName(more), per_language=10, landmarks_per_language=4).collect()}
    assert all(out[i].lang_pred == ("de" if i % 2 else "en") for i in range(40))
    assert [(out[i].lang_pred, out[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert out[103].lang_pred == "de" and out[None].lang_pred == "en" and not out[None].held_out
    none = fit(table.filter("false"))
    assert table.select(predict(none, table, F.col("text")).alias("x")).first().x.lang == "und"
    assert identify(table.limit(0)).count() == 0
    assert docs([(7, "x")]).select(is_held_out()).first()[0] in (True, False)


def test_unrecognised_texts_go(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    r = random.Random(6)
    gibberish = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 11))) for _ in range(n))
    bad = [gibberish(n) for n in (5, 30, 500)] + [f"{r.getrandbits(160):040x} {r.getrandbits(160):040x} a7", "Все люди рождаются свободными и равными"]
    more = spark.createDataFrame([(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(bad)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = {x.doc_id for x in corpus_pipeline.identify_languages(spark, docs.select(more.columns).unionByName(more), folder).collect()}
    assert kept == {x.doc_id for x in docs.select("doc_id").collect()}
    # French is not learned when no row says so; the others stay
    unlearned = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    kept = {x.doc_id for x in corpus_pipeline.identify_languages(spark, unlearned, folder).collect()}
    assert kept == {x.doc_id for x in docs.filter("lang <> 'fr'").select("doc_id").collect()}


VECTORS = "vec_id long, embedding array<float>, label int, node int"


def unit_rows():
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + r.normal(scale=0.12, size=8)).tolist(), i % 2, 0) for i in range(300)]
    rows += [(1000 + i, rows[3][1], 1, 0) for i in range(4)] + [(1100, [2 * x for x in rows[3][1]], 1, 0), (1101, rows[3][1], 0, 0)]
    return rows + [(2000, None, 1, 0), (2001, [0.0] * 8, 1, 0), (2002, [float("nan")] + [1.0] * 7, 1, 0), (2003, [None] + [1.0] * 7, 1, 0), (2004, [], 1, 0),
                   (2005, [float("inf")] * 8, 1, 0), (2006, rows[3][1], None, 0), (2007, [1.0, 2.0], 1, 0), (2008, [2.0, 4.0], 1, 0), (2009, [1e30, 2e30], 1, 0)]


def good(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("cells", [1, 20])
def test_near_duplicates(spark, cells):
    rows = unit_rows()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, VECTORS), cell_rows=300 // cells).collect()}
    vec = {i: np.array(v, np.float32).astype(float) for i, v, label, _ in rows if good(v) and any(v) and label is not None}
    label = {i: la for i, _, la, _ in rows}
    groups, n = brute.Groups(), dict.fromkeys(label, 0)
    for a in vec:
        for b in vec:
            if a < b and label[a] == label[b] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / np.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b])) >= 0.98:
                groups.join(a, b)
                n[a], n[b] = n[a] + 1, n[b] + 1
    assert got == {i: (n[i], groups.find(i), groups.find(i) == i) for i in label}
    kept = keep_representatives(spark.createDataFrame(rows, VECTORS))
    assert {r.vec_id for r in kept.collect()} == {i for i in label if groups.find(i) == i}


def test_near_duplicates_small(spark):
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, 0), (1, [1.0, 0.0], 1, 0), (None, [1.0, 0.0], 1, 0)], VECTORS)
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in near_duplicates(twice).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True)]
    assert near_duplicates(twice.limit(0)).count() == 0


def near_copies(n: int):
    """Vectors without clusters, a large group of near copies, and copies on both sides of the threshold."""
    r = np.random.default_rng(8)
    x = r.normal(size=(n, 64))
    x[: n // 10] = x[0] + r.normal(scale=0.08, size=(n // 10, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(n // 10, n // 2):
        side = r.normal(size=64)
        side -= side @ x[i] * x[i]
        c = 0.98 + r.choice([-1, 1]) * 10.0 ** -float(r.integers(2, 7))
        x[i + n // 2] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x = x.astype(np.float32)
    return [(i, v.tolist(), 1 + (i % 8 == 7), 0) for i, v in enumerate(x)], x.astype(float)


@pytest.mark.parametrize("blocks", [(65536, 1024), (150, 8)])
def test_near_duplicates_at_the_threshold(spark, monkeypatch, blocks):
    from trialspark.llm import neardup

    monkeypatch.setattr(neardup, "SIGNATURES", blocks[0])
    monkeypatch.setattr(neardup, "BLOCK", blocks[1])
    rows, x = near_copies(1200)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    label, x = np.array([r[2] for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    groups = brute.Groups()
    for a, b in zip(*np.nonzero(linked)):
        groups.join(int(a), int(b))
    assert got == {i: (int(linked[i].sum()), groups.find(i)) for i in range(len(x))}
    assert linked.sum(axis=1).max() > 64 and 0 < linked[600:].any(axis=1).sum() < 600


def test_near_duplicates_write_no_vectors_that_cannot_link(spark, monkeypatch):
    """disk stays below the input where vectors have no clusters, however many cells there are."""
    from trialspark.llm import neardup

    kept, written = neardup.held, []
    monkeypatch.setattr(neardup, "held", lambda *a, **k: written.append(kept(*a, **k)) or written[-1])
    rows, x = near_copies(4000)
    assert near_duplicates(spark.createDataFrame([r for r in rows if 400 <= r[0] < 2000], VECTORS), cell_rows=50).filter("n_links > 0").count() == 0
    size = sum(os.path.getsize(f.removeprefix("file://")) for df in written for f in df.inputFiles())
    assert size < 1600 * 64 * 4


@pytest.mark.parametrize("k", [5, 1])
def test_top_k(spark, k):
    rows = unit_rows()
    got = {}
    for r in top_k(spark.createDataFrame(rows, VECTORS), lambda key: key % 50 == 0, k=k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vec = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _, _ in rows if good(v)}
    for q in (i for i in vec if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vec[q], vec[i])), i) for i in vec if i != q and len(vec[i]) == len(vec[q]))[:k]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_ties(spark):
    rows = [(i, [1.0, 1.0], 0, 0) for i in range(30)] + [(50, [1.0, 1.0], 0, 0), (50, [1.0, 1.0], 0, 0), (100, [0.5, 0.5], 0, 0), (None, [1.0, 1.0], 0, 0)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in top_k(spark.createDataFrame(rows, VECTORS), lambda key: key % 50 == 0).collect())
    assert got == sorted([(0, n + 1, n + 1) for n in range(5)] + 2 * [(50, n + 1, n) for n in range(5)] + [(100, n + 1, n) for n in range(5)])
    assert top_k(spark.createDataFrame([], VECTORS), lambda key: key % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 0, 0), (1, [2.0], 0, 0)], VECTORS)
    assert [tuple(r) for r in top_k(alone, lambda key: key % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def mixed(spark):
    r = random.Random(2)
    rows = [(i, text_of(i, r.randrange(0, 60)), r.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for i in range(600)]
    return rows + [(600, None, "a"), (601, "", "null-only"), (None, "x y", "b"), (5, "p q r", "b"), (5, "p q r", "b"), (700, "w " * 30000, "d")]


def test_mix(spark):
    rows = mixed(spark)
    out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("old")).withColumn("key", F.lit(1))).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.size) for r in out], key=key) == sorted([(i, len(brute.words(t))) for i, t, _ in rows], key=key)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.mix_targets(sizes)
    assert len(set(sizes.values())) == len(sizes)  # so that a size names its source
    by_size = {sizes[s]: want[s] for s in sizes}
    taken = {}
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(by_size[r.source_size], abs=1e-5)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    largest = {}
    for i, t, s in rows:
        largest[sizes[s]] = max(largest.get(sizes[s], 0), len(brute.words(t)))
    assert all(abs(taken[n] - by_size[n]) <= largest[n] for n in taken)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and take_mix(empty).count() == 0


def test_take_mix(spark):
    table = spark.createDataFrame([r for r in mixed(spark) if r[0] not in (None, 5)], "doc_id long, text string, source string")
    want = {r.doc_id: r.taken // r.size for r in mix(table).collect() if r.size}
    got = {r.doc_id: r["count"] for r in take_mix(table).groupBy("doc_id").count().collect()}
    assert {i: got.get(i, 0) for i in want} == want


def test_targets_and_numbers(spark):
    names = [None, "b", "a", "\U00010000", "￿", "A"]
    table = numbered(spark.createDataFrame([(s, 10 * (i + 1)) for i, s in enumerate(names)], "source string, source_size long"))
    assert [r.source for r in table.orderBy("source_no").collect()] == ["A", "a", "b", "￿", "\U00010000", None]
    sizes = {r.source: r.source_size for r in table.collect()}
    got = {r.source: r.target for r in targets(table, 1.5, 2, (5.0, 2.0, 1.0)).collect()}
    assert got == {s: pytest.approx(t, abs=1e-5) for s, t in brute.mix_targets(sizes).items()}


def test_lines(spark, docs):
    rows = [(i, "h1" if i < 20 else None, f"head\nline {i}\n  head \n\nfoot {i % 3}") for i in range(30)] + [(40, "h2", "head\nx"), (41, "h1", None), (42, "h1", ""), (43, "h1", "head"), (44, "h1", "v " * 40000)]
    table = spark.createDataFrame([(i, h, t, "old", 3) for i, h, t in rows], "doc_id long, host string, text string, n_lines string, marks int")
    out = drop_boilerplate(table, F.col("host"), ratio=0.4, least_pages=3).collect()
    assert {r.doc_id: r.text for r in out} == brute.boilerplate(rows, 0.4, 3)
    assert all(r.n_lines - r.n_dropped == sum(bool(x.strip(" ")) for x in (r.text or "").split("\n")) for r in out)
    assert drop_boilerplate(table.limit(0), F.col("host")).count() == 0
    urls = {"http://A.example.com/x": "a.example.com", "https://u:p@b.example:80?q": "b.example", "nothing": "", None: None}
    assert {r.u: r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_host(F.col("u")).alias("h")).collect()} == urls


def test_fixity(spark):
    rows = [(i, f"http://x/{i}", "b" * (i % 7) * 999) for i in range(3000)] + [(None, None, None), (5, "http://x/5", "other"), (6, "http://x/6", "b" * 6 * 999), (8000, "u", "l" * 70000)]
    first, second = fixity.replicas(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)))
    a, b = {(r.file, r.offset): r for r in first.collect()}, {(r.file, r.offset): r for r in second.collect()}
    want = {(k, "lost" if k not in b else "added" if k not in a else "changed") for k in a.keys() | b.keys() if k not in a or k not in b or a[k].digest != b[k].digest}
    assert {((r.file, r.offset), r.fault) for r in fixity.audit(first, second).collect()} == want and len(want) > 30
    assert {((r.file, r.offset), r.fault) for r in fixity.audit(second, first).collect()} == {(k, {"lost": "added"}.get(f, f)) for k, f in want}
    assert fixity.audit(first, first).count() == 0
    assert fixity.audit(first.limit(0), second.limit(0)).count() == 0
    assert fixity.audit(first, second.limit(0)).filter("fault = 'lost'").count() == len(a)


def test_secret_cases(spark, docs):
    r = random.Random(4)
    rows = [(i, f'say token = "{r.getrandbits(160):040x}" now' if i % 2 else f"sum of thecommonlongishwordhere {r.getrandbits(40)} end") for i in range(80)]
    rows += [(90, None), (91, ""), (92, "abcdefghijklmnop" * 5000), (93, rows[1][1]), (93, rows[1][1])]
    table = docs(rows)
    label = F.when(F.col("doc_id") < 40, F.col("before").contains("token"))
    out = secrets.scan(table, label).collect()
    assert all(x.is_secret == (x.doc_id % 2 == 1 or x.doc_id == 93) for x in out if x.doc_id < 80 or x.doc_id == 93)
    assert sum(x.doc_id == 93 for x in out) == 2 and sum(x.doc_id == 92 for x in out) == 1
    unlabelled = secrets.scan(table, F.lit(None).cast("boolean")).collect()
    assert len(unlabelled) == len(out) and all(x.is_secret and x.score is None for x in unlabelled)
    assert secrets.scan(table.limit(0), label).count() == 0


def test_secret_formats(spark, tmp_path):
    from trialspark.llm import queries

    r = random.Random(8)
    make = lambda n, chars="abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(r.choice(chars) for _ in range(n))
    digits = "0123456789abcdef"
    kinds = [lambda: "AKIA" + make(16, "ABCDEFGHIJ234567"), lambda: "ghp_" + make(36), lambda: f'secret: "{make(64, digits)}"', lambda: f"password={make(32, digits)}",
             lambda: f"auth: {make(30)}", lambda: f'credential = "zq9_{make(14)}+{make(9)}"', lambda: f'key = "{make(48, digits)}"']  # the last is in no label rule
    more = [(10**6 + i, f"The of and {kinds[i % 7]()} in the of.", "en", "src1", 1) for i in range(210)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_secret_scan(spark, str(tmp_path)).filter("doc_id >= 1000000").collect()
    assert {x.doc_id for x in found if x.is_secret} == {i for i, *_ in more}


def test_words_built_to_collide(spark, docs):
    """Words and word orders whose polynomial hashes modulo a power of two are equal are still told apart."""
    swap = str.maketrans("ab", "ba")
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    tail = [f"x{i}" for i in range(49)]
    rows = [(1, " ".join([morse, *tail])), (2, " ".join([morse.translate(swap), *tail])), (3, morse), (4, morse.translate(swap)),
            (5, " ".join(morse)), (6, " ".join(morse.translate(swap)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.sha256) for r in remove_repeats(docs(rows)).collect()}
    assert got == brute.repeats(rows, 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), 4, 85).collect()}
    assert got == brute.jaccard(rows, 4, 85)
