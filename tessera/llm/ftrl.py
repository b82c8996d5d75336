"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text's features are the distinct hashes, into 2**20 coordinates, of its words and their
stems (the first 4 to 7 characters of longer words), of neighbouring pairs and triples,
and of pairs with one or two words between. FTRL-proximal
gives each coordinate its own rate, and its L1 term keeps all but a few weights at zero,
so that the model that goes to the executors is a short list of (coordinate, weight).

Fitted on at most ``ROWS_PER_CLASS`` labelled documents of either class, by hash order of
ids; every whole text is scored. Null and empty texts have no features and get the score
of the bias alone. Without labelled rows, or with one class only, every score is the
share of label 1 (0 without rows). Repeated rows get equal scores; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, crc_mod, labelled_sample, mix, without

BITS = 20
ROWS_PER_CLASS = 3000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 4.0, 1.0, 2
HELD_OUT = (4, 2)

_find = re.compile(r"[^\W_]+").findall
STEMS = (4, 5, 6, 7)


def _hashes_of_stem(stem: str) -> int:
    return _stem_hashes[f"{stem}-"]


class _Stems(dict):
    """word -> hashes of its stems, for words seen lately (bounded)."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = tuple(_hashes_of_stem(word[:n]) for n in STEMS if len(word) > n)
        return value


_hashes, _stem_hashes, _stems = Hashes(), Hashes(), _Stems()
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _coordinates(h: np.ndarray) -> list[np.ndarray]:
    """Coordinates of words, n-grams and skip-grams, repeats included."""
    out = [mix(h)]
    for gap, salt in zip((1, 2, 3), _SALTS, strict=False):
        if len(h) > gap:
            out.append(mix(h[:-gap] * salt + h[gap:]))
    if len(h) > 2:
        out.append(mix((h[:-2] * _SALTS[0] + h[1:-1]) * _SALTS[3] + h[2:]))
    return [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in out]


def _stem_coordinates(stems) -> np.ndarray:
    return (mix(np.array(stems, np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a text."""
    words = _find(text.lower()) if text else []
    stems = list(chain.from_iterable(map(_stems.__getitem__, set(words))))
    return np.unique(np.concatenate([*_coordinates(_hashes.of(words)), _stem_coordinates(stems)]))


class Scorer:
    """Scores texts by the few non-zero weights; a word's weighted stems are kept."""

    LIMIT = 300_000

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.bias, self.dense = bias, np.zeros(1 << BITS)
        self.dense[at] = weights
        self.mask = self.dense != 0
        self.stems: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        cut = [[_hashes_of_stem(w[:n]) for n in STEMS if len(w) > n] for w in words]
        flat = _stem_coordinates(list(chain.from_iterable(cut)))
        hit, start = self.mask[flat], 0
        for w, c in zip(words, cut, strict=True):
            stop = start + len(c)
            self.stems[w] = tuple(flat[start:stop][hit[start:stop]].tolist()) if hit[start:stop].any() else ()
            start = stop

    def raw(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            words = _find(text.lower()) if text else []
            if not words:
                continue
            own = set(words)
            if new := own.difference(self.stems):
                if len(self.stems) + len(new) > self.LIMIT:
                    self.stems, new = {}, own
                self._learn(list(new))
            hits = {x for s in map(self.stems.__getitem__, own) if s for x in s}
            for c in _coordinates(_hashes.of(words)):
                hits.update(c[self.mask[c]].tolist())
            if hits:
                out[i] += self.dense[sorted(hits)].sum()
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of the non-zero part of the model."""
    size = (1 << BITS) + 1  # the last coordinate is the bias, without L1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weight(at):
        zi = z[at]
        w = (np.sign(zi) * l1[at] - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zi) <= l1[at]] = 0.0
        return w

    times = np.ones(len(labels)) if times is None else times
    if len(labels) and 0 < labels.mean() < 1:
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(labels)):
                at = np.append(rows[i], size - 1)
                w = weight(at)
                p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = (p - labels[i]) * times[i]
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
        every = weight(np.arange(size))
        at = np.flatnonzero(every[:-1])
        return at, every[at], float(every[-1])
    share = float(labels.mean()) if len(labels) else 0.0
    return np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def _featurise(frames):
    for pdf in frames:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "f": [features(t).astype(np.int32) for t in pdf["text"]]})


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS):
    modulus, held = HELD_OUT
    keep = crc_mod("doc_id", modulus) != held
    sample = labelled_sample(docs, labels, "toxic", rows_per_class, keep)
    # above the bound the classes are sampled apart; each weighs what it does among all labels
    known = labels.where(keep & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("v"))
    share = {r["v"]: r["n"] for r in known.groupBy("v").agg(F.count("*").alias("n")).collect()}
    weigh = {v: n / min(n, rows_per_class) for v, n in share.items()}
    mean = sum(share.values()) / max(1, sum(min(n, rows_per_class) for n in share.values()))
    rows = sample.mapInPandas(_featurise, "doc_id long, label int, f array<int>")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        y = pdf["label"].to_numpy(float)
        at, weights, bias = fit(pdf["f"].tolist(), y, np.array([weigh.get(int(v), mean) / mean for v in y]))
        return pd.DataFrame({"at": [at], "weights": [weights], "bias": [bias]})

    # the bounded sample is learned in one task; the driver gets the non-zero weights alone
    got = rows.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(learn, "at array<long>, weights array<double>, bias double").collect()
    if not got:
        return fit([], np.zeros(0))
    return np.array(got[0]["at"], np.int64), np.array(got[0]["weights"], float), got[0]["bias"]


def _score(model):
    scorers: list[Scorer] = []

    def run(texts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.append(Scorer(*model))
        raw = scorers[0].raw(texts.tolist())
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))))

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` with toxicity ``score`` and ``predicted``; columns of these names give way."""
    rows = without(docs, "score", "predicted").select(F.struct("*").alias("row"), _score(model)(F.col("text")).alias("score"))
    return rows.select("row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
