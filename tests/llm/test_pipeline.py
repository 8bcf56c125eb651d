"""Each stage of the pipeline against brute force on its own input."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline as P  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard_join", "source_mix", "byte_bpe"]

    def step(name):
        nonlocal docs
        docs = P.held(stages[name](spark, docs, FOLDER), name)
        return docs.collect()

    known = step("language_id")
    letters = {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in known} == letters and docs.columns == columns

    cut = step("line_dedup")
    assert {r.doc_id: r.text for r in cut} == brute.boilerplate([(r.doc_id, r.source, r.text) for r in known], 0.1, 5)
    assert all(r.n_chars == len(r.text) for r in cut) and docs.columns == columns

    kept = step("ngram_jaccard_join")
    groups = brute.jaccard([(r.doc_id, r.text) for r in cut], 5, 80)
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in groups.values()}) and docs.columns == columns

    mixed = step("source_mix")
    size = {r.doc_id: len(brute.words(r.text)) for r in kept}
    source = {r.doc_id: r.source for r in kept}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    largest = {s: max(n for i, n in size.items() if source[i] == s) for s in sizes}
    assert all(abs(taken[s] - t) <= largest[s] for s, t in brute.mix_targets(sizes).items()) and docs.columns == columns

    ids = step("byte_bpe")
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in mixed)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in ids)
    assert P.run(spark, FOLDER).count() == len(ids)


def test_stages_keep_foreign_columns(spark):
    """Columns named like those that operators add come through unchanged."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns(
        {c: P.F.concat(P.F.lit(c), "doc_id") for c in ("score", "held_out", "lang_pred", "recognised", "n_lines", "n_dropped", "host", "__bad")})
    for stage in (P.identify_languages, P.dedup_lines):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        for c in docs.columns[5:]:
            assert out.filter(P.F.col(c) != P.F.concat(P.F.lit(c), "doc_id")).count() == 0
        assert stage(spark, docs.limit(0), FOLDER).count() == 0 if stage is P.dedup_lines else True
