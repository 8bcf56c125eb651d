"""Language identification with string kernels.

Kernel: blended spectrum with presence, k(x, y) = common distinct letter n-grams of lengths 1 to 3, divided
by the geometric mean of both counts. Nyström: a text is described by its kernel values with landmark
texts, mapped so that inner products reproduce the kernel between landmarks. Classifier: one kernel ridge
regression per language against the rest. Scoring multiplies a batch's presence matrix with the landmarks'
and the result with the weights.

Rejection: a language knows the 3-grams of at least COMMON of its learning texts. A text is recognised if its
winner knows enough of the 3-grams of the text's words; how much is enough comes from the learning texts that the
language wins, so it does not depend on the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialspark.llm.common import hash_sample, held

#: Symbols of the n-grams: 0 any run of non-letters, 1 any rare letter, the rest the most frequent letters.
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Rows of a presence matrix.
BLOCK = 256
UNKNOWN = "und"
#: A 3-gram is known to a language if this share of its learning texts has it, and two of them at least.
COMMON = 0.03
#: Texts are recognised from this part of what nearly all learning texts of a language reach (all but LOWEST of them).
ENOUGH, LOWEST = 0.6, 0.005


def symbol_table(letters: list[int]) -> np.ndarray:
    """Symbol of each code point; both cases of a letter share one."""
    table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    for symbol, code in enumerate(letters, start=2):
        for c in {chr(code), chr(code).upper()}:
            if len(c) == 1:
                table[ord(c)] = symbol
    return table


def presence(text: str, table: np.ndarray, out: np.ndarray) -> bool:
    """Mark the n-grams of a text in `out` (GRAMS booleans, all false before); False if it has no letter."""
    symbols = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    symbols = np.concatenate(([0], symbols, [0]))
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    s = symbols[keep]
    if not len(s):
        return False
    s = np.concatenate(([0], s))
    pairs = s[:-1] << SYMBOL_BITS | s[1:]
    out[s] = True
    out[pairs + SYMBOLS] = True
    out[(pairs[:-1] << SYMBOL_BITS | s[2:]) + SYMBOLS + SYMBOLS**2] = True
    return True


#: Code points of digits.
DIGITS = np.fromiter((chr(c).isdigit() for c in range(0x110000)), bool, 0x110000)


def word_grams(text: str, table: np.ndarray) -> np.ndarray:
    """Every 3-gram of a text's words, with repeats; runs of letters and digits that hold a digit (ids, hashes) count as blank."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    symbols, digit = table[codes].astype(np.int32), DIGITS[codes]
    run = np.cumsum((symbols == 0) & ~digit)
    symbols[np.bincount(run, digit, len(codes) + 1)[run] > 0] = 0
    symbols = np.concatenate(([0], symbols, [0]))
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    s = np.concatenate(([0], symbols[keep]))
    return (s[:-2] << SYMBOL_BITS | s[1:-1]) << SYMBOL_BITS | s[2:]


@dataclass
class LanguageModel:
    """Landmark n-grams (grams x landmarks), their sizes, and the weights of each language.

    At most GRAMS x (landmarks + languages) numbers, whatever the corpus. `known` says which 3-grams each
    language knows, `floors` how much of a text it has to know.
    """

    languages: list[str]
    table: np.ndarray
    grams: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None
    known: np.ndarray | None = None
    floors: np.ndarray | None = None

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of texts with the landmarks; which texts have letters."""
        rows, sizes, ok = np.zeros((len(texts), len(self.grams)), np.float32), np.ones(len(texts)), np.zeros(len(texts), bool)
        mark = np.zeros(GRAMS, bool)
        for i, text in enumerate(texts):
            if text and presence(text, self.table, mark):
                ok[i], sizes[i], rows[i] = True, np.count_nonzero(mark), mark[self.grams]
                mark[:] = False
        common = (rows @ self.landmarks).astype(np.float64)  # whole numbers, exact in any order
        return common / np.sqrt(sizes[:, None] * self.sizes[None, :]), ok

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, share of 3-grams known to the language, and whether that is enough, of each text."""
        if self.weights is None:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [False] * len(texts)
        kernel, ok = self.kernel(texts)
        scores = np.round(kernel @ self.weights + self.offsets, 9)
        best = scores.argmax(axis=1)
        value = np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1).round(6)
        share = np.zeros(len(texts))
        for i in np.flatnonzero(ok) if self.known is not None else ():
            grams = word_grams(texts[i], self.table)
            share[i] = self.known[best[i]][grams].mean() if len(grams) else 0
        enough = ok & (share > 0) & (share >= self.floors[best]) if self.floors is not None else np.zeros(len(texts), bool)
        return ([self.languages[b] if o else UNKNOWN for b, o in zip(best, ok)], [float(v) if o else 0.0 for v, o in zip(value, ok)],
                share.round(6).tolist(), enough.tolist())


def _letters(sample: DataFrame) -> list[int]:
    """The most frequent letters of a sample, lower-cased."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                code, n = np.unique(np.frombuffer(text.as_py().lower().encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n)], names=["code", "n"])

    rows = sample.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(8 * SYMBOLS).collect()
    return [r.code for r in rows if chr(r.code).isalpha()][: SYMBOLS - 2]


def _landmarks(chosen: DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                mark = np.zeros(GRAMS, bool)
                presence(text.as_py(), table, mark)
                yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(mark).astype(np.int32)], pa.list_(pa.int32()))], names=["grams"])

    found = [np.array(r.grams) for r in chosen.select("text").mapInArrow(grams, "grams array<int>").collect() if r.grams]
    found.sort(key=lambda x: (len(x), x.tobytes()))
    if not found:
        return np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty(0)
    used = np.unique(np.concatenate(found))
    matrix = np.zeros((len(used), len(found)), np.float32)
    for i, g in enumerate(found):
        matrix[np.searchsorted(used, g), i] = 1
    return used, matrix, np.array([len(g) for g in found], np.float64)


def fit(labelled: DataFrame, per_language: int = 1000, landmarks_per_language: int = 24, ridge: float = 1e-2) -> LanguageModel:
    """A model from labelled rows (doc_id, text, lang).

    Fitted on at most per_language rows of each language (a documented bound: those of least hash of
    doc_id), of which the first landmarks_per_language are landmarks. Null texts and languages and texts
    without letters are left out; without any usable row the model answers `und` throughout.
    """
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = hash_sample(usable.select("doc_id", "lang"), "lang", per_language, "doc_id").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
    ids = picked.groupBy("doc_id").agg(F.min("place").alias("place"))
    # the picked ids are few (per_language for each language); repeated rows of one id are cut again
    sample = usable.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    again = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    sample = held(sample.withColumn("row", F.row_number().over(again)).filter(F.col("row") <= per_language), "language-sample")
    languages = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    table = symbol_table(_letters(sample))
    model = LanguageModel(languages, table, *_landmarks(sample.filter(F.col("row") <= landmarks_per_language), table))
    if not len(model.sizes):
        return model
    rows = [(r.lang, r.k) for r in _kernel_rows(sample, model).collect() if r.k is not None]
    kernel = np.array([k for _, k in rows])
    target = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    between = (model.landmarks.T @ model.landmarks).astype(np.float64) / np.sqrt(np.outer(model.sizes, model.sizes))
    value, vector = np.linalg.eigh(between)
    good = value > 1e-8 * value.max()
    nystroem = vector[:, good] / np.sqrt(value[good])
    features = kernel @ nystroem
    middle, mean = features.mean(axis=0), target.mean(axis=0)
    centred = features - middle
    inner = centred.T @ centred + ridge * np.eye(centred.shape[1])
    beta = np.linalg.solve(inner, centred.T @ (target - mean))
    model.weights, model.offsets = nystroem @ beta, mean - middle @ beta
    model.known = _known(sample, model)
    answers = sample.select(predict(model, sample, F.col("text")).alias("x")).select("x.lang", "x.known").filter(F.col("lang") != UNKNOWN)
    least = {r.lang: r.low for r in answers.groupBy("lang").agg(F.expr(f"percentile(known, {LOWEST})").alias("low")).collect()}
    model.floors = np.array([ENOUGH * least.get(lang, 0.0) for lang in languages])
    return model


def _known(sample: DataFrame, model: LanguageModel) -> np.ndarray:
    """Which 3-grams each language knows (languages x 3-grams)."""
    table, languages = sample.sparkSession.sparkContext.broadcast(model.table), model.languages

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))[np.unique(word_grams(text, table.value))] += 1
        for lang, n in counts.items():
            gram = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int32)), pa.array(n[gram])], names=["lang", "gram", "n"])

    rows = sample.groupBy("lang").agg(F.count("*").alias("rows"))  # one row a language
    found = sample.select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = found.join(F.broadcast(rows), "lang").filter((F.col("n") >= 2) & (F.col("n") >= COMMON * F.col("rows")))
    known = np.zeros((len(languages), SYMBOLS**3), bool)
    for r in found.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect():
        known[languages.index(r.lang), r.grams] = True
    return known


def _kernel_rows(sample: DataFrame, model: LanguageModel) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                kernel, ok = shared.value.kernel(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k if o else None for k, o in zip(kernel, ok)], pa.list_(pa.float64()))], names=["lang", "k"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, k array<double>")


def predict(model: LanguageModel, documents: DataFrame, text: Column) -> Column:
    """struct(lang string, score double, known double, recognised boolean) of a text; `und`, 0, 0 and false for
    null texts and texts without letters.

    Texts of any length count whole. The score is the winner's regression value, from -1 to 1, moved to 0 to 1;
    known is the share of the text's 3-grams that the winner knows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.predict(texts.slice(at, BLOCK).to_pylist()) for at in range(0, len(texts), BLOCK)]
            columns = [[x for part in parts for x in part[i]] for i in range(4)]
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "score", "known", "recognised"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double, known double, recognised boolean")(text)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of fitting: crc32 of the id as text leaves 1 modulo 3. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame, **settings) -> DataFrame:
    """documents with held_out, lang_pred, score and recognised; fitted on the rows that are not held out.

    Only the text is an input of a prediction. Repeated rows get equal answers, an empty table stays empty;
    columns named like the new ones are replaced.
    """
    plain = documents.select("doc_id", "text", "lang")
    model = fit(plain.filter(~is_held_out()), **settings)
    found = documents.withColumn("__found", predict(model, documents, F.col("text").cast("string")))
    return found.withColumns({"held_out": is_held_out(), "lang_pred": F.col("__found.lang"), "score": F.col("__found.score"), "recognised": F.col("__found.recognised")}).drop("__found")
