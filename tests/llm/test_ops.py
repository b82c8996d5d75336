import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, same
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import bitsliced, boosting, common, crf, ftrl, fuzzylines, langid, licenses, mixing, neardup, packing, tokens
from tessera.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"
ODD = [
    (1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, "x", "y"), (None, "some words here", "en", "a", 3, "x", "y"),
    (3, "1 ² ½ \n\n \t", "en", None, 3, "x", "y"), (4, "word " * 30_000, "en", "a", 9, "x", "y"),
    (5, "same text of five words\nCopyright 2020\nReleased under the MIT License.", "fr", "b", 9, None, None),
    (5, "same text of five words\nCopyright 2020\nReleased under the MIT License.", "fr", "b", 9, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(QUERIES[name](spark, DATA), ORACLES[name], connect(DATA))


def _everything(docs, labels):
    yield crf.label(docs, crf.train(docs, labels))
    yield ftrl.score(docs, ftrl.train(docs, labels))
    yield boosting.score(docs, boosting.train(docs, labels))
    yield langid.predict(docs, langid.train(docs))
    yield licenses.scan(docs)
    yield fuzzylines.dedupe(docs)
    yield mixing.taken(docs)


def test_odd_rows_and_empty_tables(spark, odd, labels):
    for out in _everything(odd, labels):
        rows = [r.asDict() for r in out.collect()]
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows if isinstance(r.get("score"), float)) and all(r.get("predicted", 0) in (0, 1) for r in rows)
    for out in _everything(odd.limit(0), labels.limit(0)):
        assert out.collect() == []
    assert neardup.classes(odd).count() == 5 and neardup.classes(odd.limit(0)).count() == 0
    assert packing.pack(odd).groupBy("doc_id").count().count() == 6 and packing.pack(odd.limit(0)).count() == 0
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd.limit(0)).count() == 0
    und = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.train(odd)).collect()}
    assert und[1] == und[2] == und[3] == "und"
    got = {r.doc_id: (r.notice_lines, r.notices) for r in licenses.scan(odd).collect()}
    assert got[5] == (1, "MIT") and got[1] == (0, "")


def test_licence_texts_match_whole(spark):
    body = licenses.TEXTS["MIT"].upper().replace("LICENSE", "Licence").replace(",", " ,")
    docs = spark.createDataFrame([(1, "MIT License\nCopyright (c) 2001 A B\n\n" + body), (2, body + " more")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs).collect()} == {1: "MIT", 2: None}


def test_every_known_licence_behind_comment_signs(spark):
    rows = []
    for i, (name, body) in enumerate(sorted(licenses.TEXTS.items())):
        title = [t.upper() for t in licenses.TITLES.get(name, [])[-1:]]
        lines = [*title, "Copyright (c) 1999-2024 Some One", *body.split("\n")]
        rows += [(3 * i, name, "\r\n".join(f" * {x}  " for x in lines)), (3 * i + 1, name, "\n\n".join(f"# {x}" for x in lines)), (3 * i + 2, None, body.replace("IS PROVIDED", "IS NOT PROVIDED", 1).replace("is provided", "is not provided", 1))]
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    wrong = [(r.doc_id, r.want, r.license) for r in licenses.scan(docs).collect() if r.want != r.license]
    assert not wrong and len(licenses.TEXTS) == 9


def test_bitsliced_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, -1.0]), (1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, [0.5, nan]), (3, None), (4, [0.1, None]), (5, [1.0]), (50, [-3.5, 2.25]), (None, [1.0, 1.0]), (7, [0.0, 0.0])]
    got = bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 131072), (0, 2, 1, 131072), (50, 1, 7, 0), (50, 2, 0, -896 * 256 - 576 * 256)]
    rng = np.random.default_rng(1)
    q = rng.integers(-40, 40, (300, 9))
    block = bitsliced.Block(rng.permutation(300), q)
    for i in range(0, 300, 7):
        at, s = block.top(int(block.ids[i]), block.q[i], 5)
        every = block.q @ block.q[i]
        want = [j for j in np.lexsort((block.ids, -every)) if j != i][:5]
        assert at.tolist() == want and s.tolist() == every[want].tolist()


def test_bitsliced_twins_and_wide_components(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-1.0, 0.5]), (1, [2.0**54, 0.0]), (2, [-(2.0**54), 3.0]), (3, [0.0, 2.0**-8]), (100, [0.0, 1.0]), (4, [2.0**1020, 0.0]), (150, [0.0, 0.0])]
    rows[0:0] = [(6, [2.0**40, -1.0])]
    exact = [(i, [int(c) * 256 if abs(c) >= 2**53 else int(np.floor(c * 256)) for c in x]) for i, x in rows]
    want = []
    for n, (i, x) in enumerate(exact):
        if i in (100, 150):
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for m, (j, y) in enumerate(exact) if m != n)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    vectors = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = bitsliced.top_k(vectors(rows), (F.col("vec_id") % 50 == 0) & (F.col("vec_id") > 50))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # each row of an id is a query, and its twins are candidates
    twins = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-1.0, 0.5]), (7, [0.25, 0.25])]
    got = sorted(map(tuple, bitsliced.top_k(vectors(twins), F.col("vec_id") % 50 == 0, k=3).collect()))
    near = [(50, 1, 50, 5 * 65536), (50, 2, 7, 49152), (50, 3, 50, 0)]
    assert got == sorted([*near, *near, (50, 1, 50, 0), (50, 2, 50, 0), (50, 3, 7, -8192)])


def test_repeated_words_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        want = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert crf.repeated_words(words) == len(want)


def test_viterbi_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        field = crf.Field(rng.normal(size=crf.N_FEATURES), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, crf.N_FEATURES))
        s = x @ field.emission

        def total(y, s=s, field=field):
            return sum(s[i] for i in range(len(y)) if y[i]) + sum(field.chain[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(total([(m >> i) & 1 for i in range(n)]) for m in range(1 << n))
        assert np.isclose(total([int(v) for v in field.decode(x)]), best)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack(docs, with_ids=True).toPandas()
    whole = tokens.encoder().whole
    text = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, g in rows.sort_values("start").groupby("doc_id"):
        ids = [i for p in g["ids"] for i in p]
        assert ids == [*whole.encode(text[doc_id], add_special_tokens=False).ids, tokens.END_ID]
        assert (g["doc_tokens"] == len(ids)).all() and g["start"].tolist() == np.cumsum([0, *map(len, g["ids"])])[:-1].tolist()
    for _, r in rows.iterrows():
        assert r.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4")) and r.length == len(r["ids"])
    ends = rows.groupby("sequence_id").agg(last=("offset", "max"), total=("length", "sum"), n=("offset", "count")).sort_index()
    assert (ends["total"][:-1] == packing.LENGTH).all() and ends.index.tolist() == list(range(len(ends)))


def test_mixture_has_the_words_it_says(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.taken(docs).collect()}
    words = {r.doc_id: r.w for r in mixing.mixed(docs).groupBy("doc_id").agg(F.sum(common.word_count(F.col("text"))).alias("w")).collect()}
    assert words == {k: t for k, (t, _) in taken.items() if t}
    assert all(t <= 2 * n for t, n in taken.values())


def _edit(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def _near_classes(texts):
    """Brute force: the least member of each connected component of similar pairs."""
    regions, root = [neardup.shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if neardup.similarity(regions[i], regions[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("pairs_per_row", [0, 2])
def test_neardup_of_drifting_copies(spark, monkeypatch, pairs_per_row):
    """Copies of copies, of which few are similar to one head: stars and the exact join link them all."""
    monkeypatch.setattr(neardup, "PAIRS_PER_ROW", pairs_per_row)
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(30):
            words = list(words)
            words[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join([f"p{i}" for i in range(60)] + [f"z{i}-{j}" for j in range(20)]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _near_classes(texts)
    got = [r.class_id for r in neardup.classes(docs).orderBy("doc_id").collect()]
    assert got == want and 4 <= len(set(want[:120])) < 20


def test_neardup_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 150))] for _ in range(25)]
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(_edit(rng, b, k)) for b in base for k in (0, 0, 1, 2, 4)] + [" ".join(passage + [f"z{i}-{j}" for j in range(20)]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    regions = [neardup.shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if neardup.similarity(regions[i], regions[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [find(i) for i in range(len(texts))]
    got = [r.class_id for r in neardup.classes(docs).orderBy("doc_id").collect()]
    assert sum(a != b for a, b in zip(want, got, strict=True)) <= 1  # a pair just at 0.8 may share no band
    assert all(neardup.classes(docs).where("doc_id < 2").select("class_id").distinct().collect()[0][0] == 0 for _ in [0])


def test_fuzzy_lines(spark):
    rng = random.Random(5)
    line = " ".join(f"word{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(300))
    near = line.replace(line.split()[7], "changedword", 1)
    docs = spark.createDataFrame([(1, f"{line}\nkeep me"), (2, f"Other line\n{near}\nOTHER line 7"), (3, "12 34\n12 34\n")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_cut) for r in fuzzylines.dedupe(docs).collect()}
    assert got == {1: (f"{line}\nkeep me", 0), 2: ("Other line", 2), 3: ("12 34\n12 34\n", 0)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


KINDS = {"words": None, "4 % of letters": 0.04, "6 % of letters": 0.06, "8 % of letters": 0.08, "9 % of letters": 0.09, "a letter put in at every 16th place": 16}


def _changed(rng, line, word, how):
    if how is None:
        ws = line.split()
        for at in rng.sample(range(len(ws)), max(1, len(ws) // 12)):
            ws[at] = word()[: rng.randint(2, 9)]
        return " ".join(ws)
    if how == 16:
        return "".join(c + (rng.choice("etao") if i % 16 == 15 else "") for i, c in enumerate(line))
    cs = list(line)
    for at in rng.sample([j for j, c in enumerate(cs) if c != " "], max(1, int(len(cs) * how))):
        cs[at] = rng.choice("etaoinshrdlucmfw".replace(cs[at], ""))
    return "".join(cs)


def test_fuzzy_lines_finds_similar_lines_of_every_length(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9)))
    rows, found = [], {kind: [] for kind in KINDS}
    for i, (k, kind) in enumerate((k, kind) for k in (5, 8, 12, 20, 30, 60, 100, 120) for kind in KINDS for _ in range(10)):
        while True:
            line = " ".join(word() for _ in range(k))
            near = _changed(rng, line, word, KINDS[kind])
            if near != line and _distance(line, near) <= 0.1 * max(len(line), len(near)):
                break
        rows += [(2 * i, line), (2 * i + 1, near)]
        found[kind].append(2 * i + 1)
    cut = {r.doc_id for r in fuzzylines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).where("n_cut = 1").collect()}
    assert cut <= {x for ids in found.values() for x in ids}  # no line that is not similar
    recall = {kind: len(cut & set(ids)) / len(ids) for kind, ids in found.items()}
    assert min(recall.values()) >= 0.95, recall


def _edited(rng, line, how):
    """``line`` with as many edits as it allows, as evenly spread as may be: no word need be left."""
    cs, most = list(line), int(0.1 * len(line) + 1e-9)
    for k in reversed(range(most)):
        at = min((k + 1) * len(line) // (most + 1), len(line) - 2)
        if how == "changed":
            cs[at] = rng.choice("bcdfg")
        elif how == "left out":
            del cs[at]
        else:
            cs.insert(at, rng.choice("bcdfg"))
    return "".join(cs).strip()


def test_fuzzy_lines_finds_every_similar_pair(spark, monkeypatch):
    rng = random.Random(9)
    common = ["the", "of", "and", "thnd", "erth", "onre", "tion", "haes", "in", "stou"]  # no word is rare
    lines = []
    for n in (10, 11, 19, 20, 25, 29, 30, 38, 39, 40, 44, 59, 60, 79, 100, 101, 150, 260, 400):
        for how in ("changed", "left out", "put in"):
            line = ""
            while len(line) < n:
                line = f"{line} {rng.choice(common)}".strip()
            line = line[:n].strip() + "x" * (n - len(line[:n].strip()))
            lines += [line, _edited(rng, line, how)]
    lines += ["ha " * 60 + "end", "ha " * 59 + "hb end", "k" * 300, "k" * 280]
    passage = " ".join(rng.choice(common) for _ in range(30))
    lines += [passage[:at] + "q" + passage[at + 1 :] for at in range(0, len(passage), 3)]  # a group of near copies
    lines = list(dict.fromkeys(" ".join(x.split()) for x in lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    a, b = docs.toDF("a", "x"), docs.toDF("b", "y")
    longer = F.greatest(F.length("x"), F.length("y"))
    near = a.join(b, F.col("a") < F.col("b")).where(F.levenshtein("x", "y") <= F.floor(longer * 0.1 + 1e-9)).select("a", "b").collect()
    label = list(range(len(lines)))
    for _ in lines:
        for r in near:
            label[r.a] = label[r.b] = min(label[r.a], label[r.b])
    want = {i for i, first in enumerate(label) if first != i}
    assert len(want) > 90

    def cut():
        return {r.doc_id for r in fuzzylines.dedupe(docs).where("n_cut = 1").collect()}

    assert cut() == want
    # the same in many blocks; and in a task, looked at in small parts, with no pair known before
    monkeypatch.setattr(fuzzylines, "BLOCK", 1500)
    assert cut() == want
    monkeypatch.setattr(fuzzylines, "CHUNK", 300)
    monkeypatch.setattr(fuzzylines, "AT_ONCE", 40)
    ids, yes = pa.array(range(len(lines))), pa.array([True] * len(lines))
    met = fuzzylines._meet(0.9)(pa.table({"id": ids, "label": ids, "norm": lines, "chars": [len(x) for x in lines], "is_x": yes, "is_y": yes}))
    assert {(r.a, r.b) for r in near} <= set(zip(met["src"].to_pylist(), met["dst"].to_pylist(), strict=True))


def test_fuzzy_lines_send_few_copies_of_a_line_at_once(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(40)) for _ in range(60)]
    lines += [x[:-1] + "z" for x in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    blocks, sent = fuzzylines._blocks, []

    def seen(*args):
        sent.append(blocks(*args).agg(F.sum("chars")).first()[0])
        return blocks(*args)

    monkeypatch.setattr(fuzzylines, "_blocks", seen)
    monkeypatch.setattr(fuzzylines, "BLOCK", 800)
    monkeypatch.setattr(fuzzylines, "ROUND", 1, raising=False)
    cut = {r.doc_id for r in fuzzylines.dedupe(docs).where("n_cut = 1").collect()}
    assert cut == set(range(60, 80))
    assert max(sent) <= 4 * sum(map(len, lines)), sent  # all blocks at once: over 10 times the text


def test_materialize_leaves_no_shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = store.getAllFiles().size()
    rows = common.materialize(spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    assert store.getAllFiles().size() <= before
    assert rows.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_fuzzy_lines_of_one_passage_and_of_no_blanks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    # lines that share a passage and are unlike, and three near copies among them
    rows = [(i, f"{passage} {' '.join(word() for _ in range(30))}") for i in range(200)]
    rows += [(1000 + i, rows[i][1][:-12] + "another end") for i in (3, 77, 150)]
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    rows += [(2000, han), (2001, han[:40] + "\u4e00" + han[41:]), (2002, "k" * 100_000 + " end"), (2003, "k" * 100_000 + " and")]
    marks = "\u0915\u093f \u0915\u0940 \u0915\u0941"
    rows += [(3000, marks), (3001, marks.replace("\u0940", "\u0947"))]  # unlike by their vowel signs only
    cut = {r.doc_id for r in fuzzylines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).where("n_cut = 1").collect()}
    assert cut == {1003, 1077, 1150, 2001, 2003}


def test_fuzzy_lines_letters_bound_the_distance(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwzé") for _ in range(rng.randint(2, 9)))
    rows = []
    for _ in range(400):
        a = b = " ".join(word() for _ in range(rng.randint(2, 14)))
        for _ in range(rng.randint(1, max(1, len(a) // 10))):
            at = rng.randrange(len(b) + 1)
            b = b[:at] + rng.choice(["", "e", "z", "q", "é", " "]) + b[at + rng.randint(0, 1) :]
        if _distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9):
            rows.append((len(rows), a, b))
    lines = spark.createDataFrame(rows, "id long, a string, b string")
    side = lambda c: lines.select("id", F.col(c).alias("norm"), F.length(c).alias("chars")).select(F.lit(0).alias("key"), "id", "chars", F.lit(0).alias("at"), *fuzzylines._letters())
    left, right = side("a"), side("b").withColumn("id", F.col("id") + 1000)
    pairs = left.join(right.toDF(*[f"o_{c}" for c in right.columns]), F.col("id") + 1000 == F.col("o_id"))
    assert len(rows) > 200 and fuzzylines._candidates(pairs, 0.9).count() == len(rows)  # a similar pair is never left out


def test_fuzzy_lines_compares_no_short_lines_of_other_letters(spark, monkeypatch):
    rng = random.Random(8)
    part = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(8))
    rows = [(i, f"{part()} {part()} rareword {part()} {part()}") for i in range(150)]
    rows.append((1000, rows[70][1][:-1] + "x"))
    linked, tried = fuzzylines._linked, []
    monkeypatch.setattr(fuzzylines, "_linked", lambda pairs, *rest: tried.append(pairs.count()) or linked(pairs, *rest))
    got = {r.doc_id for r in fuzzylines.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).where("n_cut = 1").collect()}
    assert got == {1000} and sum(tried) < 500, tried  # all that share the word: over 10,000 pairs


def test_near_duplicates_count_regions_without_a_join(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{base} a{i} b{i} c{i % 3}") for i in range(30)] + [(99, "of its own words only here")], "doc_id long, text string")
    plans, write = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name, *rest: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name, *rest))
    near = docs.select("doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("open"))
    got = neardup._rare_regions(docs, near, neardup.SHINGLE, 0.8).collect()
    assert "Join" not in plans["neardup-prefixes"]
    # the prefix of a text: of its n regions the n - ceil(0.8 n) + 1 of least count, less those it has alone
    texts = {r.doc_id: neardup.shingles(r.text).view("int64").tolist() for r in docs.collect()}
    count = {}
    for of in texts.values():
        for x in of:
            count[x] = count.get(x, 0) + 1
    want = set()
    for i, of in texts.items():
        n = len(of)
        first = sorted(of, key=lambda x: (count[x], x))[: n + (-8 * n // 10) + 1]
        want |= {(i, x) for x in first if count[x] > 1}
    assert {(r.doc_id, r.region) for r in got} == want


def test_learned_operators_hold_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    for name, column, least in (("op3_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.95)):
        got = QUERIES[name](spark, d).where("held_out").join(labels, "doc_id")
        assert got.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0] >= least
    got = QUERIES["op9_language_id"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.95


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "src long, dst long")
    got = {r.id: r.label for r in common.components(e).collect()}
    assert set(got[i] for i in range(1, 41)) == {1} and {got[100], got[101], got[102]} == {100} and len(got) == 43


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols = docs.columns
    for name, stage in p.STAGES[:-1]:
        new = common.materialize(stage(spark, docs, DATA), "test")
        assert new.columns == cols, name
        assert 0 < new.count()
        docs = new
    assert p.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_scorer_survives_a_full_cache():
    at = np.arange(0, 1 << ftrl.BITS, 50)
    texts = [" ".join(f"word{i * j}x" for j in range(40)) for i in range(30)]
    scorer = ftrl.Scorer(at, np.ones(len(at)), 0.0)
    scorer.LIMIT = 60
    want = [float(np.isin(ftrl.features(t), at).sum()) for t in texts]
    assert np.allclose(scorer.raw(texts), want)


def test_columns_of_the_names_that_are_added(spark, labels):
    rows = [(i, "some plain words of a text " * 20 + str(i), "en", "s", 9, 7.0, 5, "x") for i in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n_cut string")
    docs = docs.select("*", *[F.lit("own").alias(c) for c in ("digest", "license", "notices", "text_md5", "copy", "take", "row", "lang_pred")])
    for out in _everything(docs, labels):
        assert len(set(out.columns)) == len(out.columns) and len(out.collect()) == 5
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {(r.copy_, r.score) for r in mixed.withColumnRenamed("copy", "copy_").collect()} == {("own", 7.0)}


def test_ids_of_every_character_below_the_first_unusual_one():
    bpe = tokens.encoder()
    texts = [f"{chr(c)}li ve a{chr(c)}b {chr(c)}{chr(c)}1 'S" for c in range(0x20, 0x260)]
    for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        assert ids.tolist() == bpe.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_large_components_take_part(spark):
    v = spark.createDataFrame([(0, [5e6, 1.0]), (50, [1.0, 1.0]), (7, [2.0, float("inf")]), (8, [-3e6, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitsliced.top_k(v, F.col("vec_id") % 50 == 0).collect()}
    q = lambda *x: [int(256 * c // 1) for c in x]
    dot = lambda a, b: sum(x * y for x, y in zip(q(*a), q(*b), strict=True))
    assert got[50, 1] == (0, dot((1.0, 1.0), (5e6, 1.0))) and got[50, 2] == (8, dot((1.0, 1.0), (-3e6, 2.0))) and got[0, 2] == (8, dot((5e6, 1.0), (-3e6, 2.0)))
