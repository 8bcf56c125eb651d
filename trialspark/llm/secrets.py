"""Secret scans: candidate strings judged by a random forest that removes false positives.

A candidate is a long run of key characters. Its features are length, character classes and transitions,
coverage by dictionary words, the path of the document and the neighbouring words. The forest is fitted on
labelled findings; only fitting is bounded, every candidate of every text is found and scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.common import hash_sample, held

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=\-]{16,}")
#: Characters kept on either side of a candidate for its neighbouring words.
CONTEXT = 64

# Words beside secrets, words beside harmless examples, and path parts of tests and examples.
KEY_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "credential", "auth", "bearer", "apikey")
DUMMY_WORDS = ("example", "sample", "test", "dummy", "placeholder", "changeme", "xxxx", "hash", "checksum", "commit")
DUMMY_PATHS = ("test", "example", "sample", "doc", "fixture", "lock")

# Formats that name themselves (cloud key ids, tokens with prefixes, signed web tokens), values that are
# secrets where a key word is assigned (hex of the usual lengths; 20 or more characters with lower, upper and digits),
# and findings that are harmless for certain.
ASSIGNED = r"(?i)(token|key|secret|password|passwd|pwd|credentials?|auth|bearer)[\"']?\s*(=>|=|:)?\s*[\"']?$"
INSIDE = r"^[A-Za-z0-9_\-]*(?i:token|key|secret|password|passwd|pwd|credentials?|auth)="
SELF_NAMED = (r"^([A-Za-z0-9_\-]+=)?((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
              r"|xox[abeprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|[srp]k_(live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]{16,})$")
VALUE = r"^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_\-]{20,}={0,2})$"
HASH_BEFORE = r"(?i)(checksum|commit|sha-?1|sha-?256|md5|digest|revision)[\"']?\s*[=:]?\s*[\"']?$"
WORDS = r"^([a-z]+|[A-Z]+|[A-Z][a-z]+)$"
NUMBER = r"^[0-9+\-]+$"
RULE = r"^[=\-_+/]+$"

FINDING = "doc_id long, start int, candidate string, before string, after string, path string"


def find_candidates(documents: DataFrame, path_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, candidate, before, after, path): every candidate of every text, start in characters.

    Null and empty texts have none; repeated rows give their candidates again; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("candidate", pa.string()), ("before", pa.string()), ("after", pa.string()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, text, path in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    for m in CANDIDATE.finditer(text or ""):
                        a, b = m.span()
                        rows.append((doc, a, m[0], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT], path))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    return docs.mapInArrow(run, FINDING)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def coverage(text: str, dictionary: frozenset[str]) -> float:
    """Share of the characters covered by dictionary words of 3 to 12 letters, longest first."""
    text, at, covered = text.lower(), 0, 0
    while at < len(text):
        for n in range(12, 2, -1):
            if text[at:at + n] in dictionary:
                at, covered = at + n, covered + n
                break
        else:
            at += 1
    return covered / len(text)


def features(candidate: str, before: str, after: str, path: str | None, dictionary: frozenset[str]) -> list[float]:
    n = len(candidate)
    kinds = [_kind(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    pairs = list(zip(candidate, candidate[1:]))
    counts = Counter(candidate)
    near, right = before.lower(), after.lower()
    last = re.findall(r"[a-z_]+", near)[-3:]
    where = (path or "").lower()
    return [
        float(n), *share,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1),  # transitions between character classes
        sum(a == b for a, b in pairs) / (n - 1),
        sum(a.lower() in "aeiou" for a, _ in pairs) / (n - 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        coverage(candidate, dictionary),
        float(any(w in part for part in last for w in KEY_WORDS)),
        float(any(w in part for part in last for w in DUMMY_WORDS)),
        float(any(w in right for w in DUMMY_WORDS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", near))),
        float(near[-1:] in "\"'" and right[:1] in "\"'" and bool(near[-1:]) and bool(right[:1])),
        float(any(w in where for w in DUMMY_PATHS)), float(where.count("/")),
    ]


class SecretModel:
    """A fitted forest and the dictionary that its features use; both are bounded by the settings of fit."""

    def __init__(self, forest: RandomForestClassificationModel | None, dictionary: frozenset[str]):
        self.forest, self.dictionary = forest, dictionary

    def featured(self, findings: DataFrame) -> DataFrame:
        shared = findings.sparkSession.sparkContext.broadcast(self.dictionary)

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                yield pa.array([features(*row, shared.value) for row in zip(*(c.to_pylist() for c in columns))], pa.list_(pa.float64()))

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return findings.withColumn("features", array_to_vector(F.arrow_udf(run, "array<double>")("candidate", "before", "after", "path")))

    def score(self, findings: DataFrame, threshold: float = 0.5) -> DataFrame:
        """findings with score (probability of a secret) and is_secret.

        Without a model (no labels of both kinds) the score is null and every finding stays a secret.
        """
        if self.forest is None:
            return findings.withColumns({"score": F.lit(None).cast("double"), "is_secret": F.lit(True)})
        out = self.forest.transform(self.featured(findings)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
        return out.withColumn("is_secret", F.col("score") >= threshold).drop("features", "rawPrediction", "probability", "prediction")


def fit(labelled: DataFrame, per_label: int = 4000, trees: int = 30, depth: int = 8, words: int = 4000) -> SecretModel:
    """A model from findings with a boolean column `label`; null labels are left out.

    Fitted on at most per_label findings of each label (a documented bound: those of least hash); the
    dictionary holds at most `words` words of 3 to 12 letters from around these findings.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("candidate", "doc_id", "start"), "doc_id", "start")
    sample = hash_sample(labelled.filter("label IS NOT NULL"), "label", per_label, "candidate", "doc_id", "start").withColumn("row", F.row_number().over(order)).filter(F.col("row") <= per_label).drop("row")
    sample = held(sample, "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return SecretModel(None, frozenset())
    around = sample.select(F.explode(F.split(F.lower(F.concat_ws(" ", "before", "after")), "[^a-z]+")).alias("word"))
    common = around.filter("length(word) BETWEEN 3 AND 12").groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(words)
    model = SecretModel(None, frozenset(r.word for r in common.collect()))
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7)
    rows = held(model.featured(sample).select("features", F.col("label").cast("double").alias("y")), "secret-features")
    model.forest = forest.fit(rows)
    return model


def known_label() -> Column:
    """True for findings in a known secret format, false for those harmless for certain, null for all others.

    Harmless are words (letters of one case), numbers of cards and phones, ruled lines, and hashes after a checksum or
    commit word; none of them counts as harmless where a key word is assigned.
    """
    candidate, before = F.col("candidate"), F.col("before")
    inside = candidate.rlike(INSIDE)
    assigned = before.rlike(ASSIGNED) | inside
    secret = candidate.rlike(SELF_NAMED) | assigned & F.regexp_replace(candidate, INSIDE, "").rlike(VALUE)
    hashed = before.rlike(HASH_BEFORE) & candidate.rlike("^[0-9a-fA-F]+$")
    harmless = ~assigned & (candidate.rlike(WORDS) | candidate.rlike(NUMBER) | candidate.rlike(RULE) | hashed)
    return F.when(secret & ~hashed, True).when(harmless, False)


def scan(documents: DataFrame, label=None, path_col: str = "source", **settings) -> DataFrame:
    """Every candidate of documents with score and is_secret; `label` is a column over findings, null where unknown."""
    findings = held(find_candidates(documents, path_col), "candidates")
    model = fit(findings.withColumn("label", F.lit(None).cast("boolean") if label is None else label), **settings)
    return model.score(findings)
