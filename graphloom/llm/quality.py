"""Operator 4: quality rules by distribution divergence.

References: for each language, over all documents that carry its label, the histogram of
seven character classes and of the language's commonest words (all others in one bin).
A document's two histograms are compared with its language's reference (without one:
with all, the nearest counts) by Jensen-Shannon distance in base 2, from 0 to 1.
Short documents have noisy histograms: below a minimum length a comparison is not made.

Two narrow scans of the texts; the references need one shuffle of pre-summed counts.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_slices

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
CLASSES = 7  # lower, upper, other letter, digit, white space, punctuation, the rest
FLUSH = 200_000


@dataclass(frozen=True)
class Limits:
    """Documented parameters: a text fails beyond these distances, if it has the minimum length.

    ``common`` is the length of the common-word list of each language.
    """

    common: int = 100
    min_chars: int = 200
    max_char_distance: float = 0.28
    min_words: int = 50
    max_word_distance: float = 0.58
    min_reference_words: int = 500


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, 6, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))
        if k in ("Ll", "Lu"):
            out[cp] = 0 if k == "Ll" else 1
        elif k[0] in "LM":
            out[cp] = 2
        elif k[0] == "N":
            out[cp] = 3
        elif k[0] == "Z" or cp in (9, 10, 11, 12, 13):
            out[cp] = 4
        elif k[0] == "P":
            out[cp] = 5
    return out


def class_histograms(texts: list[str | None]) -> np.ndarray:
    """Counts of the character classes, a row for each text."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) if t else 0 for t in texts])
    return np.bincount(doc * CLASSES + char_classes()[points], minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)


def bare(word: bytes) -> str:
    """A word's form in the word lists: lower case, without punctuation around it."""
    return word.decode("utf-8").lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…¿¡")


def base_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words); a null text has nothing."""
    if not text:
        return [], 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space only
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, again = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                again += 1
            elif line.strip(SPACES):
                seen.add(line)
    repeated = 0
    if len(words) > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 5 - max(i, end)
                    end = i + 5
    return words, word_chars, symbols, again, repeated


@dataclass(frozen=True)
class References:
    """By language: class shares, common words in order and their shares (the last: all other words)."""

    languages: tuple[str, ...]
    classes: tuple[tuple[float, ...], ...]
    words: tuple[tuple[str, ...], ...]
    shares: tuple[tuple[float, ...], ...]


def learn(docs: DataFrame, limits: Limits = Limits()) -> References:
    """Count the references over all rows with a non-null lang (columns text, lang).

    Tasks send summed counts; Spark keeps each language's top words before the
    final ranking, so (common + classes + 1) numbers a language reach the driver.
    """

    def count(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CLASSES, np.int64))

        def flush():
            rows = []
            for lang, c in counts.items():
                forms: Counter = Counter()
                for word, n in c.items():
                    forms[bare(word)] += n
                rows += [(lang, "w", w, n) for w, n in forms.items()]
                rows.append((lang, "t", "", sum(c.values())))
            counts.clear()
            for i in range(0, len(rows), 100_000):
                a, b, c, d = zip(*rows[i : i + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d, pa.int64())], ["lang", "kind", "item", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, texts in text_slices(batch.column(0)):
                for lang, row, text in zip(langs[a:b], class_histograms(texts), texts, strict=True):
                    classes[lang] += row
                    counts[lang].update(text.encode("utf-8", "surrogatepass").split())
                if sum(map(len, counts.values())) > FLUSH:
                    yield from flush()
        yield from flush()
        rows = [(lang, "c", str(k), int(n)) for lang, row in classes.items() for k, n in enumerate(row)]
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d, pa.int64())], ["lang", "kind", "item", "n"])

    parts = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, kind string, item string, n long")
    total = parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = total.withColumn("r", rank).filter(F.col("r") <= limits.common).collect()
    by: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for r in sorted(top, key=lambda r: r.r):
        by[r.lang][r.kind].append((r.item, r.n))
    languages = sorted(k for k, v in by.items() if v["t"] and v["t"][0][1] >= limits.min_reference_words)
    classes, words, shares = [], [], []
    for lang in languages:
        c = dict(by[lang]["c"])
        row = np.array([c.get(str(k), 0) for k in range(CLASSES)], float)
        classes.append(tuple((row / max(row.sum(), 1)).tolist()))
        all_words = by[lang]["t"][0][1]
        words.append(tuple(w for w, _ in by[lang]["w"]))
        share = [n / all_words for _, n in by[lang]["w"]]
        shares.append((*share, max(0.0, 1 - sum(share))))
    return References(tuple(languages), tuple(classes), tuple(words), tuple(shares))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of rows of shares, in base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(kl / 2, 0, 1))


class Judge:
    def __init__(self, refs: References, limits: Limits):
        self.refs, self.limits = refs, limits
        self.number = {lang: k for k, lang in enumerate(refs.languages)}
        self.places = [{w: i for i, w in enumerate(words)} for words in refs.words]
        self.forms: dict[bytes, str] = {}

    def form(self, word: bytes) -> str:
        got = self.forms.get(word)
        if got is None:
            if len(self.forms) > 200_000:
                self.forms.clear()
            got = self.forms[word] = bare(word)
        return got

    def word_distance(self, words: list[str], k: int) -> float:
        place, share = self.places[k], np.array(self.refs.shares[k])
        n = len(share) - 1
        found = np.bincount([place.get(w, n) for w in words], minlength=n + 1)
        return float(jensen_shannon(found / len(words), share))

    def rows(self, texts: list[str | None], langs: list[str | None]) -> list[tuple]:
        out, classes = [], class_histograms(texts)
        every = range(len(self.refs.languages))
        for text, lang, row in zip(texts, langs, classes, strict=True):
            words, chars, symbols, again, repeated = base_counts(text)
            n = len(words)
            failed = n < 10 or 100 * repeated > 20 * n
            against = [self.number[lang]] if lang in self.number else list(every)
            by_char = by_word = None
            if against and row.sum() >= self.limits.min_chars:
                share = row / row.sum()
                by_char = min(float(jensen_shannon(share, np.array(self.refs.classes[k]))) for k in against)
            if against and n >= self.limits.min_words:
                forms = [self.form(w) for w in words]
                by_word = min(self.word_distance(forms, k) for k in against)
            far = (by_char is not None and by_char > self.limits.max_char_distance) or (by_word is not None and by_word > self.limits.max_word_distance)
            out.append((n, chars, symbols, again, repeated, failed, not failed and not far, by_char, by_word))
        return out


@functools.lru_cache(maxsize=2)
def judge(refs: References, limits: Limits) -> Judge:
    return Judge(refs, limits)


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())]
TYPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality_column(text: Column, lang: Column, refs: References, limits: Limits = Limits()) -> Column:
    """struct with the base counts, both distances (null: not compared) and the verdict."""

    @F.arrow_udf(TYPE)
    def rate(text: pa.Array, lang: pa.Array) -> pa.Array:
        langs, rows = lang.to_pylist(), []
        for a, b, texts in text_slices(text):
            rows += judge(refs, limits).rows(texts, langs[a:b])
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], [f for f, _ in FIELDS])

    return rate(text, lang)


def rate_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each document: doc_id, base counts, base_failed, kept, the two distances.

    Null or empty text: zero counts, base_failed.  Null or unseen lang: the nearest reference.
    Empty table: empty result.  Repeated rows count each time; other columns are ignored.
    """
    own = docs.select("doc_id", "text", "lang")
    refs = learn(own, limits)
    return own.select("doc_id", quality_column(F.col("text"), F.col("lang"), refs, limits).alias("_q")).select("doc_id", "_q.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
