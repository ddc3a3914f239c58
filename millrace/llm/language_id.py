"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point.  An n-gram binds its
letters: their vectors, each permuted (rotated) by its place, are multiplied.  A text is the
bundle (sum) of its n-grams' vectors, a language's prototype the bundle of its texts.  A text
gets the language whose prototype has the largest cosine with the text's vector.

train() bundles in every task and adds up one vector for each language and task; the driver only
gets one vector for each language.  Text is lower-cased letter by letter; whatever is not a letter
parts words, and each word counts with a space before and after it.

Edge cases: a text that is null or has no letters is `und` with score 0; rows with a null lang or
text teach nothing; equal cosines give the language that sorts first; without any language learned
every text is `und`.  A null doc_id is in neither part of the split: it counts as held out.
Columns besides doc_id, text and lang are ignored, but returned by known_languages().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

DIMENSION = 1024
N = 3
#: n-grams whose vectors a worker keeps; others are bound anew each time.
KEPT = 1 << 15
UNKNOWN = "und"
_SPACE = 0x20
_folded: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point the lower-case letter, or 0 if it is no letter."""
    if not _folded:
        table = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            if (c := chr(point)).isalpha():
                table[point] = ord(low) if len(low := c.lower()) == 1 else point
        _folded.append(table)
    return _folded[0]


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """The n-grams of a text, each as one number of 21 bits a letter; empty without letters."""
    letters = _fold()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    known = letters > 0
    if not known.any():
        return np.zeros(0, np.int64)
    keep = known | np.concatenate([[False], known[:-1]])  # one space for what lies between words
    letters = np.concatenate([[_SPACE], np.where(known, letters, _SPACE)[keep], [_SPACE]]).astype(np.int64)
    if not known[-1]:
        letters = letters[:-1]
    out = np.zeros(len(letters) - n + 1, np.int64)
    for k in range(n):
        out = (out << 21) | letters[k : len(letters) - n + 1 + k]
    return out


class Encoder:
    """Bundles of n-grams.  Vectors of frequent n-grams are kept."""

    def __init__(self, dimension: int = DIMENSION, n: int = N):
        self.dimension, self.n = dimension, n
        self.letters: dict[int, np.ndarray] = {}
        self.known = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.kept = np.empty((KEPT, dimension), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([7, point]).integers(0, 2, self.dimension, dtype=np.int8) * np.int8(2) - np.int8(1)
        return self.letters[point]

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(self.dimension, np.int8)
        for k in range(self.n):
            out = out * np.roll(self.letter(code >> 21 * k & 0x1FFFFF), k)
        return out

    def bundle(self, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct, sorted codes, each so many times."""
        if not len(codes):
            return np.zeros(self.dimension, np.float64)
        if not len(self.known):
            at, found = None, np.zeros(len(codes), bool)
        else:
            at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            found = self.known[at] == codes
        if not found.all() and len(self.known) < KEPT:
            new = codes[~found][: KEPT - len(self.known)]
            for k, code in enumerate(new.tolist(), len(self.known)):
                self.kept[k] = self.bind(code)
            known = np.concatenate([self.known, new])
            place = np.concatenate([self.place, np.arange(len(self.place), len(self.place) + len(new))])
            order = np.argsort(known)
            self.known, self.place = known[order], place[order]
            at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            found = self.known[at] == codes
        total = np.zeros(self.dimension)
        for begin in range(0, len(codes), 1024):
            part = slice(begin, begin + 1024)
            own = found[part]
            total += times[part][own].astype(np.float32) @ self.kept[self.place[at[part][own]]].astype(np.float32)
        for code, many in zip(codes[~found], times[~found]):
            total += int(many) * self.bind(int(code)).astype(np.float64)
        return total


def _bundler(dimension: int, n: int):
    def bundle(batches):
        encoder, totals = Encoder(dimension, n), {}
        for batch in batches:
            of: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                of.setdefault(lang, []).append(ngrams(text, n))
                if sum(map(len, of[lang])) > 1 << 22:
                    totals[lang] = totals.get(lang, 0) + encoder.bundle(*np.unique(np.concatenate(of.pop(lang)), return_counts=True))
            for lang, codes in of.items():
                totals[lang] = totals.get(lang, 0) + encoder.bundle(*np.unique(np.concatenate(codes), return_counts=True))
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "vector": [v.tolist() for v in totals.values()]})

    return bundle


def train(docs: DataFrame, dimension: int = DIMENSION, n: int = N) -> dict[str, np.ndarray]:
    """Prototypes of the languages of docs (text, lang)."""
    labelled = docs.select("text", "lang").where("text is not null and lang is not null")
    parts = labelled.transform(common.map_batches, _bundler(dimension, n), "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for lang, k, v in sums.collect():  # dimension numbers for each language
        out.setdefault(lang, np.zeros(dimension))[k] = v
    return dict(sorted(out.items()))


def _predictor(prototypes: dict[str, np.ndarray], dimension: int, n: int):
    def predict(batches):
        encoder = Encoder(dimension, n)
        names = list(prototypes)
        unit = np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()]).reshape(len(names), dimension)
        for batch in batches:
            preds, scores = [], []
            for text in batch.column("text").to_pylist():
                codes = ngrams(text, n)
                if not len(codes) or not names:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                vector = encoder.bundle(*np.unique(codes, return_counts=True))
                cosines = unit @ vector / (np.linalg.norm(vector) or 1)
                best = int(np.argmax(cosines))
                preds.append(names[best])
                scores.append(float(min(1, max(0, cosines[best]))))
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keys: list[str], dimension: int = DIMENSION, n: int = N) -> DataFrame:
    """The keys columns of docs, lang_pred and score (the cosine, 0 at least)."""
    keyed = docs.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text")
    return keyed.transform(common.map_batches, _predictor(prototypes, dimension, n), f"{schema}, lang_pred string, score double")


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def known_languages(docs: DataFrame, score: float = 0.0) -> DataFrame:
    """docs whose language is one of those learned, with a score above the given one.

    Documents without letters go.  Rows that share a doc_id are judged together: they stay if one
    of them does.
    """
    found = predict(docs, train(docs.where(~held_out())), ["doc_id"])
    bad = found.groupBy("doc_id").agg(F.max(F.when(F.col("lang_pred") != UNKNOWN, F.col("score")).otherwise(-1.0)).alias("best")).where(F.col("best") <= score)
    bad = common.save(bad.select(F.col("doc_id").alias("_id")), "unknown-language")
    return common.by_id(docs, common.small(bad), "left_anti")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(keyed, train(docs.where(~held_out())), ["doc_id", "held_out"])
