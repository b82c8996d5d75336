"""Spelling variants: Aho-Corasick automata over the halves of words.

Two words that differ by one inserted, deleted or replaced code point share one of the two
halves of either word: the left one at the start, or the right one at the end. Automaton shards
hold both halves of every word; every word is scanned by the shards that can hold a half of a
near word. A hit counts if its offset is that of its half and the lengths differ by one at most;
within the other half, in the same way, one of its halves must be there. What is left is
verified. A shard returns a count and the best near word for each word, never pairs.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
#: Words of a shard, about.
SHARD_WORDS = 16_384
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts: maximal runs of Latin letters, A-Z lower-cased; where 31 divides the
    crc32 h of ``<doc_id>:<run>``, without the code point h % length."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run"))
    rows = rows.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.expr("substring(run, 1, int(h % length(run)))"), F.col("run").substr(at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    got = rows.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return got.where(F.col("n") >= least_count)


def one_apart(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from x to y."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _keys(rest: str) -> tuple:
    """The halves of a word's other half, where they stand in it."""
    k = len(rest) // 2
    return ("<", rest[:k]), (">", rest[k:])


def _probes(rest: str, length: int):
    """What ``_keys`` gives for any text of ``length`` that is one edit from ``rest``."""
    k = length // 2
    yield "<", rest[:k]
    yield ">", rest[max(0, len(rest) - (length - k)) :]


def _automaton(held: list[tuple[str, str]]):
    """Payload of a half: its length and, for the words that start ("L") or end ("R") with it, the
    words by length and halves of the other half."""
    halves: dict[str, dict] = {}
    for w, side in held:
        k = len(w) // 2
        half, rest = (w[:k], w[k:]) if side == "L" else (w[k:], w[:k])
        for key in _keys(rest):
            halves.setdefault(half, {}).setdefault((side, len(w), *key), []).append(w)
    automaton = ahocorasick.Automaton()
    for half, index in halves.items():
        automaton.add_word(half, (len(half), index, sorted({k[:2] for k in index})))
    automaton.make_automaton()
    return automaton


def _near(automaton, x: str):
    """The words near ``x`` that a shard tells of: those of which it holds the left half if ``x``
    starts with that, else the right half. So each is told once, by one shard."""
    n, seen = len(x), {x}
    for end, (size, index, kinds) in automaton.iter(x):
        for side, length in kinds:
            left, k = side == "L", length // 2
            # the half stands at the word's start, or at its end
            if abs(length - n) > 1 or size != (k if left else length - k) or end != (size - 1 if left else n - 1):
                continue
            rest = x[size:] if left else x[: n - size]
            for probe in _probes(rest, length - size):
                for w in index.get((side, length, *probe), ()):
                    if w not in seen and (left or not x.startswith(w[:k])):
                        seen.add(w)
                        if one_apart(x, w):
                            yield w


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    held, asked = rows[rows["held"]], rows.loc[~rows["held"], "word"].unique()
    out = []
    if len(held) and len(asked):
        count = dict(zip(held["word"], held["n"], strict=True))
        automaton = _automaton(list(zip(held["word"], held["side"], strict=True)))
        for x in asked:
            n, best = 0, None
            for w in _near(automaton, x):
                n += 1
                if best is None or (-count[w], w) < best:
                    best = (-count[w], w)
            if n:
                out.append((x, n, -best[0], best[1]))
    return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])


def near_words(known: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, near, near_n): for each word of (word, n) that has near words their number
    and the one of largest n (ties: the smallest). Words are distinct and of two code points at least.

    A half's shard follows from the half, so that a word is asked of the few shards of the halves
    that it can share. A half of more than ``shard_words`` words is dealt over parts, and so are
    the words that ask for it."""
    shards = max(1, -(-2 * known.count() // shard_words))
    size, text = F.length("word"), F.col("word")
    own = F.array(
        F.struct(F.lit("L").alias("side"), text.substr(F.lit(1), F.floor(size / 2).cast("int")).alias("half")),
        F.struct(F.lit("R").alias("side"), text.substr(F.floor(size / 2).cast("int") + 1, size).alias("half")),
    )
    held = known.select("word", "n", F.explode(own).alias("o")).select("word", "n", "o.*")
    # halves of a near word: its length differs by one at most
    least = lambda n, up: F.floor((n + up) / 2).cast("int")
    lefts = F.array_distinct(F.array(*[text.substr(F.lit(1), least(size, d)) for d in (-1, 0, 1)]))
    rights = F.array_distinct(F.array(*[text.substr(F.greatest(size - least(size, d + 1) + 1, F.lit(1)), size) for d in (-1, 0, 1)]))
    of = lambda side: lambda half: F.struct(F.lit(side).alias("side"), half.alias("half"))
    pairs = F.concat(F.transform(lefts, of("L")), F.transform(rights, of("R")))
    asked = known.select("word", F.lit(None).cast("long").alias("n"), F.explode(pairs).alias("o")).select("word", "n", "o.*")
    crowded = held.groupBy("side", "half").count().where(F.col("count") > shard_words)
    crowded = crowded.select("side", "half", F.ceil(F.col("count") / shard_words).cast("int").alias("parts"))
    parts, rows = F.coalesce("parts", F.lit(1)), []
    every = F.sequence(F.lit(0), parts - 1)
    for frame, is_held in ((held, True), (asked, False)):
        dealt = frame.join(crowded, ["side", "half"], "left")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), parts).cast("int")).withColumn("other", F.explode(every))
        i, j = ("own", "other") if is_held else ("other", "own")
        # a half of one part goes to a shard of many halves
        shard = F.when(parts > 1, F.xxhash64("side", "half", i, j)).otherwise(F.pmod(F.xxhash64("side", "half"), F.lit(shards)))
        rows.append(dealt.select(shard.alias("shard"), (parts > 1).alias("split"), "word", "n", "side", F.lit(is_held).alias("held")))
    found = rows[0].unionByName(rows[1]).groupBy("shard", "split").applyInPandas(_scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts of (doc_id, text).

    A form has at least ``times`` the occurrences of its variant, so chains of forms end; they
    are followed by doubling. Null and empty texts have no words; a null ``doc_id`` counts as
    an empty one; repeated rows count again; other columns are ignored.
    """
    known = materialize(words(docs), "words")
    near = materialize(near_words(known), "near-words")
    rows = known.join(near, "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    far, turn = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:
        turn += 1
        step = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = materialize(far.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{turn}")
        if far.where("moved").isEmpty():
            break
        far = far.select("word", "root")
    return rows.join(far.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
