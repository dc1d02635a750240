"""Operator 3: language identification with hyperdimensional profiles.

Every letter symbol has a random +-1 vector.  A trigram's vector binds the three
letters: rotate(a, 2) * rotate(b, 1) * c.  Bundling (adding) the trigram vectors of a
text gives its profile; the profiles of a language's training texts bundle to its
prototype.  A text belongs to the language whose prototype has the largest cosine.

cosine(text, prototype) = sum of count(g) * <g, prototype> / (|text| |prototype|), so the
products <g, prototype> are computed once per distinct trigram and worker, and the text's own
norm, common to all languages, cancels in the comparison.

The score says how well the text fits any language, whatever their number: the largest mean of <g, prototype>
over the text's trigrams in units of the mean over the language's own training texts (``levels``), cut to 0..1.
A text of the language is expected at 1 whatever its length.  A mean that unknown trigrams may give by chance scores 0:
one below z standard deviations sqrt(sum of count(g)^2) / sum of count(g), z = 2 or, for many languages, sqrt(2 ln K).

Training reads at most about ``max_train_docs`` labelled rows (a documented bound;
rows are chosen by a hash of doc_id); prediction reads every whole text in a narrow scan.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

SYMBOLS = 128
SEED = 20240229


@functools.lru_cache(maxsize=1)
def letter_symbols() -> np.ndarray:
    """Code point -> symbol: 0 no letter, 1-26 a-z, 27-59 U+00DF-U+00FF, 60-127 hashed."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            if 0x61 <= low <= 0x7A:
                out[cp] = low - 0x60
            elif 0xDF <= low <= 0xFF:
                out[cp] = 27 + low - 0xDF
            else:
                out[cp] = 60 + (low * 2654435761 >> 7) % 68
    return out


@functools.lru_cache(maxsize=4)
def letter_vectors(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, dim), np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of trigram codes."""
    v = letter_vectors(dim)
    a, b, c = codes >> 14, codes >> 7 & 127, codes & 127
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram codes, number of the text of each); runs of non-letters count as one boundary."""
    flat = "\0".join([t or "" for t in texts] + [""])
    points = np.frombuffer(("\0" + flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    doc = np.append(np.repeat(np.arange(len(texts)), sizes), len(texts) - 1)[: len(points)]
    sym = letter_symbols()[points]
    keep = np.append(True, (sym[1:] != 0) | (sym[:-1] != 0))
    sym, doc = sym[keep].astype(np.int32), doc[keep]
    if len(sym) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    inside = np.flatnonzero(sym[1:-1])
    code = (sym[:-2] << 14 | sym[1:-1] << 7 | sym[2:])[inside]
    # the boundary before a text's first letter is the last place of the text before
    return code, doc[1:-1][inside]


class GramIndex:
    """Trigram code -> compact number, assigned as codes appear."""

    def __init__(self):
        self.slot = np.full(1 << 21, -1, np.int32)
        self.codes = np.empty(0, np.int32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.slot[codes]
        if (new := at < 0).any():
            fresh = np.unique(codes[new])
            self.slot[fresh] = np.arange(len(self.codes), len(self.codes) + len(fresh))
            self.codes = np.concatenate([self.codes, fresh])
            at = self.slot[codes]
        return at


@dataclass(frozen=True)
class Model:
    """Prototypes: languages in order, their unit vectors as float32 bytes, mean products of their own trigrams."""

    languages: tuple[str, ...]
    dim: int
    prototypes: bytes
    levels: tuple[float, ...]

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.prototypes, np.float32).reshape(len(self.languages), self.dim)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.index = model, GramIndex()
        self.products = np.empty((0, len(model.languages)), np.float32)

    def cosines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosines up to each text's own norm, number of trigrams, sum of squared trigram counts) by text."""
        code, doc = trigrams(texts)
        at = self.index(code)
        known = len(self.products)
        if known < len(self.index.codes):
            new = self.index.codes[known:]
            parts = [gram_vectors(new[i : i + 2048], self.model.dim).astype(np.float32) @ self.model.matrix().T for i in range(0, len(new), 2048)]
            self.products = np.concatenate([self.products, *parts])
        n = np.bincount(doc, minlength=len(texts))
        out = np.stack([np.bincount(doc, weights=self.products[at, k], minlength=len(texts)) for k in range(len(self.model.languages))], axis=1) if self.model.languages else np.zeros((len(texts), 0))
        size = max(len(self.index.codes), 1)
        pair, count = np.unique(doc * size + at, return_counts=True)
        return out, n, np.bincount(pair // size, weights=count.astype(np.float64) ** 2, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cos, n, squares = self.cosines(texts)
        best = cos.argmax(axis=1)
        chance = max(2.0, np.sqrt(2 * np.log(len(self.model.languages)))) * np.sqrt(squares)
        level = np.array(self.model.levels) * np.maximum(n, 1)[:, None]
        fit = np.where(cos >= chance[:, None], cos / np.maximum(level, 1e-300), 0.0)
        score = np.clip(fit.max(axis=1), 0.0, 1.0)
        return [self.model.languages[b] if k else "und" for b, k in zip(best, n, strict=True)], score


@functools.lru_cache(maxsize=1)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def fit(rows: DataFrame, dim: int = 4096, max_train_docs: int = 100_000) -> Model:
    """Learn prototypes from columns key, text, lang; rows with a null text or lang are skipped.

    At most about ``max_train_docs`` rows are read, chosen by a hash of the key.
    Each task bundles its rows to one vector per language, with its number of trigrams at the end; the vectors are summed
    by Spark, and languages x (dim + 1) numbers reach the driver.
    """
    rows = rows.select("key", "text", "lang").filter("text is not null and lang is not null")
    total = rows.select("lang").count()
    if total > max_train_docs:
        rows = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * max_train_docs / total))

    def bundle(batches):
        index, counts = GramIndex(), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, texts in text_slices(batch.column(0)):
                code, doc = trigrams(texts)
                at, here = index(code), langs[a:b]
                for lang in set(here):
                    got = np.bincount(at[(here == lang)[doc]], minlength=len(index.codes))
                    old = counts.get(lang)
                    counts[lang] = got if old is None else got + np.pad(old, (0, len(got) - len(old)))
        names, vectors = list(counts), []
        for lang in names:
            used = np.flatnonzero(counts[lang])
            v = np.zeros(dim)
            for i in range(0, len(used), 2048):
                part = used[i : i + 2048]
                v += counts[lang][part].astype(np.float64) @ gram_vectors(index.codes[part], dim).astype(np.float64)
            vectors.append([*v.tolist(), float(counts[lang].sum())])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["lang", "v"])

    parts = rows.select("text", "lang").mapInArrow(bundle, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    languages = sorted({r.lang for r in sums})
    matrix = np.zeros((len(languages), dim + 1))
    number = {lang: k for k, lang in enumerate(languages)}
    for r in sums:
        matrix[number[r.lang], r.i] = r.x
    matrix, n = matrix[:, :dim], matrix[:, dim]
    norm = np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)
    matrix = matrix / norm[:, None]
    return Model(tuple(languages), dim, matrix.astype(np.float32).tobytes(), tuple((norm / np.maximum(n, 1)).tolist()))


def predict_column(text: Column, model: Model) -> Column:
    """struct(lang, score) for a column of whole texts."""

    @F.arrow_udf("lang string, score double")
    def predict(col: pa.Array) -> pa.Array:
        langs, scores = [], [np.empty(0)]
        for _, _, texts in text_slices(col):
            lang, score = scorer(model).predict(texts)
            langs += lang
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], ["lang", "score"])

    return predict(text)


def fold() -> Column:
    """crc32 of doc_id as text, modulo 5 (null doc_id: 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5


def fit_documents(docs: DataFrame) -> Model:
    """Learn from documents outside the held-out fold."""
    return fit(docs.filter(fold() != 0).select(F.col("doc_id").alias("key"), "text", "lang"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    ``und`` with score 0 for a null text, one without letters, or when nothing could be
    learned (empty table, no labels).  Ties go to the language first in order.
    """
    model = model or fit_documents(docs)
    own = docs.select("doc_id", (fold() == 0).alias("held_out"), predict_column(F.col("text"), model).alias("_p"))
    return own.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def accepted(docs: DataFrame, model: Model | None = None, min_score: float = 0.3) -> DataFrame:
    """Rows of ``docs`` (columns unchanged) whose language is recognized: not ``und``, score at least ``min_score``.

    Texts of unknown languages, of letters at random and of a single letter are dropped; close relatives of a known language may pass.

    With nothing to learn from (no labels), every text with a letter passes.
    """
    model = model or fit_documents(docs)
    if not model.languages:
        return docs.filter(F.expr(r"coalesce(regexp_like(text, '\\p{L}'), false)"))
    judged = docs.withColumn("_gl_lang", predict_column(F.col("text"), model))
    return judged.filter((F.col("_gl_lang.lang") != "und") & (F.col("_gl_lang.score") >= min_score)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
