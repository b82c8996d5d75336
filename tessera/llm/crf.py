"""Quality rules by line labelling with a linear-chain conditional random field.

Each line with a word is described by shares and flags; a two-label linear-chain CRF
(content or boilerplate) is decoded with Viterbi, so that a doubtful line follows its
neighbours. The share of a document's words that stand in content lines decides
retention; before that, documents of fewer than ``MIN_WORDS`` words, or of which over half
the words stand in repeated three-word windows, fail the base rules.

The field is fitted by maximum likelihood on at most ``ROWS_PER_CLASS`` labelled documents
of either quality, by hash order of ids; every line takes its document's label (distant
supervision). Without labelled rows, or with one class, all lines are content. Null and
empty texts have no words and fail the base rules. Repeated rows get equal results; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_weights, labelled_sample, words_of

ROWS_PER_CLASS = 1500
MIN_WORDS = 50
MAX_REPEATED = 0.5
CONTENT_SHARE = 0.5
STEPS, STEP, DECAY = 150, 0.1, 1e-3

_symbols = re.compile(r"[#*$%&|<>]").findall
_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_digits = re.compile(r"[0-9]").findall
N_FEATURES = 12
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_words long"


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that occur twice or more, first occurrence included."""
    if len(words) < 3:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: words before this index are counted already
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def lines_of(text: str) -> list[tuple[str, list[str], bool]]:
    """(line, words, equal to an earlier line) of the lines that have a word."""
    out, seen = [], set()
    for line in text.split("\n"):
        if words := words_of(line):
            out.append((line, words, line in seen))
            seen.add(line)
    return out


def features(line: str, words: list[str], repeated: bool) -> list[float]:
    n, c = len(words), len(line)
    last = line.rstrip()[-1:]
    return [
        1.0, min(1.0, n / 20), float(n <= 3), min(1.0, len(_symbols(line)) / n), min(1.0, line.count("!") / n), len(_upper(line)) / c,
        len(_digits(line)) / c, float(repeated), float(last in ".!?…"), 1.0 - len(set(words)) / n,
        min(1.0, line.count("|") / n), min(1.0, sum(map(len, words)) / n / 15),
    ]


class Field:
    """emission: log odds of content; chain[a, b]: score of label b after label a."""

    def __init__(self, emission: np.ndarray, chain: np.ndarray):
        self.emission, self.chain = emission, chain

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels, 1 for content; ties go to content."""
        scores = (x @ self.emission).tolist()
        (c00, c01), (c10, c11) = self.chain.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, s in enumerate(scores):
            if i:
                to0, to1 = (c10 + one >= c00 + zero), (c11 + one >= c01 + zero)
                back.append((to0, to1))
                zero, one = (c10 + one if to0 else c00 + zero), (c11 + one if to1 else c01 + zero) + s
            else:
                one = s
        at = one >= zero
        labels = [at]
        for to0, to1 in reversed(back):
            at = to1 if at else to0
            labels.append(at)
        return np.array(labels[::-1], bool)


def fit(documents: list[np.ndarray], labels: list[np.ndarray], weight: np.ndarray) -> Field:
    """Maximum likelihood by full-batch Adam; all documents advance a line at a time."""
    emission, chain = np.zeros(N_FEATURES), np.zeros((2, 2))
    emission[0] = 1.0
    if not documents or len({int(v) for y in labels for v in y}) < 2:
        return Field(emission, chain)
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    docs, ys, weight = [documents[i] for i in order], [labels[i] for i in order], weight[order]
    lengths = np.array([len(d) for d in docs])
    steps = [(int((lengths > t).sum())) for t in range(lengths[0])]
    xs = [np.stack([docs[i][t] for i in range(n)]) for t, n in enumerate(steps)]
    yt = [np.array([int(ys[i][t]) for i in range(n)]) for t, n in enumerate(steps)]
    params, m, v = np.concatenate([np.zeros(N_FEATURES), np.zeros(4)]), 0.0, 0.0
    for turn in range(1, STEPS + 1):
        emission, chain = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        node = [np.stack([np.zeros(n), x @ emission], 1) for n, x in zip(steps, xs, strict=True)]
        alpha = [node[0]]
        for t in range(1, len(steps)):
            alpha.append(np.logaddexp.reduce(alpha[-1][: steps[t], :, None] + chain[None], axis=1) + node[t])
        grad, beta = np.zeros_like(params), None
        last = [a.copy() for a in alpha]
        logz = np.empty(len(docs))
        for t, n in enumerate(steps):
            stop = steps[t + 1] if t + 1 < len(steps) else 0
            logz[stop:n] = np.logaddexp.reduce(last[t][stop:n], axis=1)
        for t in range(len(steps) - 1, -1, -1):
            n = steps[t]
            new = np.zeros((n, 2))
            if t + 1 < len(steps):
                k = steps[t + 1]
                ahead = node[t + 1] + beta
                pair = np.exp(alpha[t][:k, :, None] + chain[None] + ahead[:, None, :] - logz[:k, None, None]) * weight[:k, None, None]
                grad[N_FEATURES:] -= pair.sum(axis=0).ravel()
                np.add.at(grad, N_FEATURES + 2 * yt[t][:k] + yt[t + 1], weight[:k])
                new[:k] = np.logaddexp.reduce(chain[None] + ahead[:, None, :], axis=2)
            beta = new
            p = np.exp(alpha[t][:, 1] + beta[:, 1] - logz[:n])
            grad[:N_FEATURES] += (weight[:n] * (yt[t] - p)) @ xs[t]
        grad = grad / (weight @ lengths) - DECAY * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + STEP * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Field(params[:N_FEATURES].copy(), params[N_FEATURES:].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Field:
    def describe(frames):
        for pdf in frames:
            x = [np.array([features(*y) for y in lines_of(t or "")], float).ravel() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": x})

    sample = labelled_sample(docs, labels, "quality", rows_per_class, F.lit(True))
    rows = sample.mapInPandas(describe, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    rows = rows[rows["x"].map(len) > 0]
    x = [np.asarray(v, float).reshape(-1, N_FEATURES) for v in rows["x"]]
    y = [np.full(len(v), label) for v, label in zip(x, rows["label"], strict=True)]
    return fit(x, y, class_weights(labels, "quality", F.lit(True), rows["label"].to_numpy()))


def _label(field: Field, content_share: float):
    def one(text: str | None) -> tuple:
        text = text or ""
        lines = lines_of(text)
        words = [w for _, ws, _ in lines for w in ws]
        n, repeated, content = len(words), repeated_words(words), 0
        failed = n < MIN_WORDS or repeated > MAX_REPEATED * n
        if lines:
            marks = field.decode(np.array([features(*x) for x in lines], float))
            content = sum(len(ws) for (_, ws, _), good in zip(lines, marks, strict=True) if good)
        kept = not failed and content >= content_share * n
        return n, sum(map(len, words)), len(_symbols(text)), sum(r for *_, r in lines), repeated, failed, kept, len(lines), content

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=[f.split()[0] for f in RESULT.split(", ")])

    return F.pandas_udf(run, RESULT)


def label(docs: DataFrame, field: Field, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: base statistics, content words and the verdict."""
    return docs.select("doc_id", _label(field, content_share)("text").alias("v")).select("doc_id", "v.*")
