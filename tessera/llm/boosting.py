"""Document quality by histogram gradient-boosted trees over text statistics.

A text is described by some twenty statistics (shares of letters, capitals, digits,
symbols and marks, word and line lengths, repetition). Trees of a fixed depth are grown
on quantile-binned statistics with the logistic loss and are flattened into arrays
(feature, threshold, leaf value), which a batch of documents walks level by level in
numpy.

Fitted on at most ``ROWS_PER_CLASS`` labelled documents of either class, by hash order of
ids, weighted back to the classes' shares; every whole text is scored. Null and empty texts have all
statistics 0. Without labelled rows, or with one class only, every score is the share of
label 1 (1 without rows). Repeated rows get equal scores; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_weights, crc_mod, labelled_sample, mix, release, take_turn, without, word_hashes, words_of

ROWS_PER_CLASS = 4000
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAF, LAMBDA = 80, 4, 0.15, 64, 8, 1.0
HELD_OUT = (5, 0)

STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "exclaims", "pipes", "commas_dots", "colons_slashes",
    "non_ascii", "lines", "line_words", "ended_lines", "repeated_lines", "distinct_words", "repeated_triples", "top_word",
    "one_letter_words", "long_words",
)
_S = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+{}[]\\", np.uint8)


def _repeated(x: np.ndarray) -> float:
    if not len(x):
        return 0.0
    return 1.0 - len(np.unique(x)) / len(x)


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = words_of(text)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    n, w, m = max(1, int(raw.sum())), max(1, len(words)), max(1, len(lines))
    h = word_hashes(text)
    _, counts = np.unique(h, return_counts=True) if words else (None, np.zeros(1))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    triples = mix((h[:-2] * _S + h[1:-1]) * _S + h[2:]) if len(h) > 2 else h[:0]
    share = lambda chars: float(sum(int(raw[c]) for c in chars)) / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.sum()) / w, float(raw[65:91].sum()) / n, float(raw[48:58].sum()) / n,
        float(raw[_SYMBOLS].sum()) / w, raw[33] / w, raw[124] / w, share(b",."), share(b":/"),
        float(raw[128:].sum()) / n, np.log1p(len(lines)), len(words) / m, sum(x.rstrip()[-1:] in ".!?…\"')" for x in lines) / m,
        1.0 - len(set(lines)) / m, len(counts) / w if words else 0.0, _repeated(triples), float(counts.max()) / w,
        float((lengths == 1).sum()) / w, float((lengths > 20).sum()) / w,
    ]


class Trees:
    """A boosted ensemble of complete trees in flat arrays; node i has 2i+1 and 2i+2."""

    def __init__(self, prior: float):
        self.prior = prior
        self.feature = np.zeros((0, (1 << DEPTH) - 1), np.int16)
        self.threshold = np.zeros((0, (1 << DEPTH) - 1))
        self.value = np.zeros((0, 1 << DEPTH))

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.prior)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - ((1 << DEPTH) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
    weight = np.ones(len(y)) if weight is None else weight
    share = float(np.average(y, weights=weight)) if len(y) else 1.0
    model = Trees(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not 0 < share < 1:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    raw, inner = np.full(len(y), model.prior), (1 << DEPTH) - 1
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        feature, threshold, at = np.zeros(inner, np.int16), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf, None)
            if len(own) >= 2 * LEAF:
                gs, hs = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[own, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[own], h[own], None))
                    gain = gl**2 / (hl + LAMBDA) + (gs - gl) ** 2 / (hs - hl + LAMBDA) - gs**2 / (hs + LAMBDA)
                    gain[(nl < LEAF) | (len(own) - nl < LEAF)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, e[k], k)
            feature[node], threshold[node] = best[1], best[2]
            at[own] = 2 * node + 1 + ((binned[own, best[1]] > best[3]) if best[3] is not None else 0)
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + LAMBDA)
        raw = raw + value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    model.feature, model.threshold, model.value = np.stack(features), np.stack(thresholds), np.stack(values)
    return model


def _describe(frames):
    take_turn("boosting")
    for pdf in frames:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [statistics(t) for t in pdf["text"]]})


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Trees:
    modulus, held = HELD_OUT
    keep = crc_mod("doc_id", modulus) != held
    sample = labelled_sample(docs, labels, "quality", rows_per_class, keep)
    rows = sample.mapInPandas(_describe, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if not len(rows):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    y = rows["label"].to_numpy(float)
    return fit(np.stack(rows["x"].to_numpy()), y, class_weights(labels, "quality", keep, y))


def _score(model: Trees):
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        take_turn("boosting")
        out = pd.Series(model.score(np.array([statistics(t) for t in texts])))
        release()
        return out

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with quality ``score`` and ``predicted``; columns of these names give way."""
    rows = without(docs, "score", "predicted").select(F.struct("*").alias("row"), _score(model)(F.col("text")).alias("score"))
    return rows.select("row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
