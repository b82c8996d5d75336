"""Language identification by word-first backoff.

Of each language the relative frequencies of words and of character n-grams (2 to 5
characters, words marked at both ends) are learned. A text's known words count with
their log frequency in each language; an unseen word counts by the longest of its
n-grams that are known, length by length. The text's language is the one with the
largest mean; ``score`` is its share of the languages' tempered likelihoods.

Learned from at most ``ROWS_PER_LANGUAGE`` documents of each language, by hash order of
ids, keeping words and n-grams seen at least twice. Every whole text is scored. A null
text, or one without a letter, is ``und`` with score 0, as is any text when nothing could
be learned. Ties go to the language first in code-point order. Repeated rows get equal
results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, without

ROWS_PER_LANGUAGE = 1500
SIZES = (5, 4, 3, 2)
SALTS = 64
LEAST = 2
TEMPER = 25.0
HELD_OUT = (4, 2)
UNKNOWN = "und"

_find = re.compile(r"[^\W\d_]+").findall


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """languages: sorted; words, grams[n]: text -> log frequency in each language."""

    CACHE = 400_000

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        self.words = self._logs({lang: Counter({w: c for w, c in counts[lang].items() if c >= LEAST}) for lang in self.languages})
        self.grams = {}
        for n in SIZES:
            tables = {}
            for lang in self.languages:
                t: Counter = Counter()
                for w, c in counts[lang].items():
                    for g in grams(w, n):
                        t[g] += c
                tables[lang] = Counter({g: c for g, c in t.items() if c >= LEAST})
            self.grams[n] = self._logs(tables)

    def _logs(self, tables: dict[str, Counter]) -> tuple[dict[str, int], np.ndarray]:
        """The place of each known text and the matrix of log frequencies."""
        known = sorted(set().union(*tables.values())) if tables else []
        counts = np.array([[tables[lang].get(k, 0) for lang in self.languages] for k in known], float).reshape(len(known), len(self.languages))
        logs = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * max(1, len(known))))
        return {k: i for i, k in enumerate(known)}, logs.astype(np.float32)

    def _backed_off(self, word: str) -> np.ndarray:
        for n in SIZES:
            places, logs = self.grams[n]
            if hits := [places[g] for g in grams(word, n) if g in places]:
                return logs[hits].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def _start(self) -> None:
        """The places of known words, and of unseen ones met lately behind them."""
        self.places = dict(self.words[0])
        self.logs = np.concatenate([self.words[1], np.zeros((self.CACHE, len(self.languages)), np.float32)])

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_find(text.lower())) if text else Counter()
        if not self.languages or not any(any(map(str.isalpha, w)) for w in counts):
            return UNKNOWN, 0.0
        if not hasattr(self, "places"):
            self._start()
        unseen = set(counts).difference(self.places)
        if len(self.places) + len(unseen) > len(self.logs):
            self._start()
            unseen = set(counts).difference(self.places)
            if len(unseen) > self.CACHE:  # a text of more unseen words than the cache holds
                self.logs = np.concatenate([self.logs, np.zeros((len(unseen), len(self.languages)), np.float32)])
        for w in unseen:
            self.logs[len(self.places)] = self._backed_off(w)
            self.places[w] = len(self.places)
        n = sum(counts.values())
        at = np.fromiter(map(self.places.__getitem__, counts), np.int64, len(counts))
        at, times = np.sort(at), np.fromiter(counts.values(), float, len(counts))[np.argsort(at)]
        mean = np.round(times @ self.logs[at].astype(float) / n, 6)
        best = int(mean.argmax())
        # more words, more certain, up to the temper
        odds = np.exp((mean - mean[best]) * min(n, TEMPER))
        return self.languages[best], float(np.round(odds[best] / odds.sum(), 9))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    modulus, held = HELD_OUT
    # first within salted parts of a language, then among what is left of them: the same rows
    salt = F.crc32(F.col("doc_id").cast("string")) % SALTS
    parts, order = (Window.partitionBy("lang", *by).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id") for by in (["salt"], []))
    ids = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held))
        .select("doc_id", "lang", salt.alias("salt"))
        .withColumn("r", F.row_number().over(parts))
        .where(F.col("r") <= rows_per_language)
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= rows_per_language)
        .select("doc_id", "lang")
        .distinct()
    )
    known = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most rows_per_language for each language
    sample = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), ["doc_id", "lang"])

    def count(frames):
        counts: dict[str, Counter] = {}
        for pdf in frames:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                counts.setdefault(lang, Counter()).update(_find(text.lower()))
        for lang, c in ((k, v) for k, v in counts.items() if v):
            yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    rows = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return Model(counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names give way."""
    docs = without(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": pd.Series([r[0] for r in rows], dtype=object), "score": pd.Series([r[1] for r in rows], dtype=float)})

    got = F.pandas_udf(run, "lang_pred string, score double")(F.col("text"))
    return docs.select(F.struct("*").alias("row"), got.alias("p")).select("row.*", "p.lang_pred", "p.score")
