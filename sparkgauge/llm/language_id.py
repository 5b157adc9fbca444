"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from its code point and a seed). The vector of a letter
trigram binds the vectors of its letters, each permuted by its place; a text's vector bundles (adds) those of
all its trigrams, and a language's prototype adds its texts. A text gets the language whose prototype has the
highest cosine. Anything but a letter separates words, and a word's edge is a letter of its own, so that a one-letter word
has a trigram as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS, SEED = 512, 20240607
UNDETERMINED = "und"
#: A text of n letters is rejected as none of the languages below MIN_SCORE * sqrt(n / (n + HALF_LETTERS)): a short text holds few of
#: its language's trigrams, so its cosine is lower. Chance alone gives about 1 / sqrt(DIMENSIONS), 0.044.
MIN_SCORE, HALF_LETTERS = 0.2, 100
#: Prototypes sent to every task at a time, 4 bytes a dimension each; further languages take a further pass over the texts.
MAX_LANGUAGES = 5000
#: Trigrams (8 bytes each) that learning holds before it bundles them, and languages (4 KB each) whose sums a task holds.
FOLD_AT, MAX_SUMS = 500_000, 2000
#: Trigram vectors a task keeps (1 byte a dimension); beyond it, it starts anew.
MAX_CACHED = 40_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For code points of the first plane: the code point of a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(65536)], dtype=np.int64)


def trigrams(text: str) -> np.ndarray:
    """One number for each letter: the letter before, itself and the next, 21 bits each, where 0 is a word's edge."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not codes.size:
        return codes
    if codes.max() < 65536:
        codes = _letters()[codes]
    else:
        far = codes >= 65536
        kept = np.array([c if chr(c).isalpha() else 0 for c in codes[far]], dtype=np.int64)
        codes = _letters()[np.where(far, 0, codes)]
        codes[far] = kept
    codes = np.concatenate(([0], codes, [0]))
    at = codes[1:-1] > 0
    return (codes[:-2][at] << 42) | (codes[1:-1][at] << 21) | codes[2:][at]


@lru_cache(100_000)
def _letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * 2 - 1


def gram_vector(gram: int) -> np.ndarray:
    a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
    return np.roll(_letter_vector(a), 2) * np.roll(_letter_vector(b), 1) * _letter_vector(c)


class _Vectors:
    """Vectors of the trigrams seen by this worker, a row each."""

    def __init__(self):
        self.keys, self.rows = np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct grams."""
        at = np.searchsorted(self.keys, grams)
        new = grams[(at >= len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != grams)] if len(self.keys) else grams
        if len(new):
            if len(self.keys) + len(new) > MAX_CACHED:
                self.keys, self.rows, new = np.empty(0, np.int64), np.empty((0, DIMENSIONS), np.int8), grams
            keys = np.concatenate((self.keys, new))
            rows = np.concatenate((self.rows, np.stack([gram_vector(int(g)) for g in new])))
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], rows[order]
            at = np.searchsorted(self.keys, grams)
        return self.rows[at]


_VECTORS = _Vectors()


def text_vector(text: str) -> np.ndarray | None:
    """The bundled vector of a text; None without a letter."""
    grams, counts = np.unique(trigrams(text), return_counts=True)
    if not len(grams):
        return None
    return bundle(grams, counts)


def bundle(grams: np.ndarray, counts: np.ndarray, block: int = 2048) -> np.ndarray:
    """Sum of the vectors of distinct sorted grams by their counts; exact in double precision."""
    out = np.zeros(DIMENSIONS)
    for i in range(0, len(grams), block):
        rows = _VECTORS.of(grams[i : i + block])
        small = counts[i : i + block].max() < 4096
        out += (counts[i : i + block].astype(np.float32) @ rows.astype(np.float32)) if small else counts[i : i + block].astype(np.float64) @ rows.astype(np.float64)
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundled vectors of a partition's languages. Only sums are held on to: trigrams are bundled, and forgotten, every FOLD_AT."""
    sums: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    n = 0

    def fold() -> None:
        for lang, grams in waiting.items():
            distinct, counts = np.unique(np.concatenate(grams), return_counts=True)
            if len(distinct):
                sums[lang] = sums.get(lang, 0) + np.rint(bundle(distinct, counts)).astype(np.int64)
        waiting.clear()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, vector in sums.items():
            yield pa.record_batch({"lang": pa.array([lang] * DIMENSIONS), "at": pa.array(range(DIMENSIONS), pa.int32()), "value": pa.array(vector)})
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams = trigrams(text.as_py())
            waiting.setdefault(lang, []).append(grams)
            n += len(grams) + 1
            if n >= FOLD_AT or len(waiting) > MAX_SUMS:
                fold()
                n = 0
                if len(sums) > MAX_SUMS:
                    yield from flush()
    fold()
    yield from flush()


def learn(labelled: DataFrame) -> DataFrame:
    """Prototypes (lang, vector: DIMENSIONS whole numbers) from all rows of labelled (lang, text), summed in the cluster.

    Null langs, null texts and texts without a letter teach nothing. Sums are whole numbers, so the
    outcome doesn't depend on how the rows are spread. An empty table, or one without a lang, gives no prototypes.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.mapInArrow(_partial, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return materialize(sums.groupBy("lang").agg(vector.alias("vector")), "prototypes")


def _blocks(prototypes: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """All prototypes by name, MAX_LANGUAGES at a time; an empty block where there are none."""
    block, any_block = {}, False
    for r in prototypes.orderBy("lang").toLocalIterator():
        block[r.lang] = np.array(r.vector, dtype=float)
        if len(block) == MAX_LANGUAGES:
            yield block
            block, any_block = {}, True
    if block or not any_block:
        yield block


def predictor(prototypes: dict[str, np.ndarray]):
    """A column function text -> struct(lang, score, letters): the nearest of some prototypes and its cosine (0 at least).

    Null, empty and letterless texts, and all texts where there are no prototypes, are ``und`` with score 0. Of equally
    near languages the first by name wins. Whole texts count, however long.
    """
    names = sorted(prototypes)
    units = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]) if names else np.zeros((0, DIMENSIONS))

    @F.arrow_udf("struct<lang:string,score:double,letters:long>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores, letters = [], [], []
        for t in text:
            grams = trigrams(t.as_py()) if t.is_valid else ()
            letters.append(len(grams))
            if not names or not len(grams):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            vector = bundle(*np.unique(grams, return_counts=True))
            cosines = units @ vector / (np.linalg.norm(vector) or 1)
            best = int(np.argmax(cosines))
            langs.append(names[best])
            scores.append(min(1.0, max(0.0, float(cosines[best]))))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64())], ["lang", "score", "letters"])

    return predict


def with_guess(docs: DataFrame, prototypes: DataFrame) -> DataFrame:
    """docs with __guess, the nearest of all prototypes; more than MAX_LANGUAGES of them take several passes, written out in between."""
    rows, text = docs.drop("__guess"), F.col("text").cast("string")
    for i, block in enumerate(_blocks(prototypes)):
        if not i:
            rows = rows.withColumn("__guess", predictor(block)(text))
            continue
        rows = materialize(rows, "guesses").withColumn("__more", predictor(block)(text))
        rows = rows.withColumn("__guess", F.when(F.col("__more.score") > F.col("__guess.score"), F.col("__more")).otherwise(F.col("__guess"))).drop("__more")
    return rows


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; prototypes come from text and lang of the rows not held out.

    All rows and columns of docs stay, repeated ones too, but columns of these three names are replaced. See predictor for
    null, empty and letterless texts and ties.
    """
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    rows = with_guess(docs.drop("held_out", "lang_pred", "score"), prototypes)
    return rows.withColumns({"held_out": held_out(F.col("doc_id")), "lang_pred": F.col("__guess.lang"), "score": F.col("__guess.score")}).drop("__guess")


def in_some_language(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with their own columns, whose text is in one of the languages learned from the rows that are not held out.

    Null, empty and letterless texts go, and texts whose cosine with every prototype is too low for their number of letters
    (MIN_SCORE, HALF_LETTERS). Where nothing was learned (no lang on any row that is not held out, or an empty table), nothing can be
    too far from it: only texts without a letter go. Repeated rows are judged alike. Languages without a label are near no
    prototype unless they resemble one, so their long texts go.
    """
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    n, taught = F.col("__guess.letters"), not prototypes.isEmpty()
    near = F.col("__guess.score") >= least * F.sqrt(n / (n + HALF_LETTERS)) if taught else F.lit(True)
    return with_guess(docs, prototypes).where((n > 0) & near).drop("__guess")
