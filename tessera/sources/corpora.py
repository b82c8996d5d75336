"""Corpus parsers: raw files to (source, book, chapter, verse, text) rows and their kin."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_usfm


def xml_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Verses of chapter XML (``c``, ``v``; words ``w``, or ``q``, which replaces the word
    before it): path, chapter, verse, text."""

    def parse(frames):
        for pdf in frames:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                for c in ElementTree.fromstring(raw).iter("c"):
                    for v in c.iter("v"):
                        words: list[tuple[str, str]] = []
                        for x in v:
                            word = "".join(x.itertext()).strip()
                            if x.tag == "q" and words and words[-1][0] == "k":
                                words.pop()
                            if x.tag in ("w", "q", "k") and word:
                                words.append((x.tag, word))
                        out.append((p, int(c.get("n")), int(v.get("n")), " ".join(w for _, w in words)))
            yield pd.DataFrame(out, columns=["path", "chapter", "verse", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, chapter int, verse int, text string")


def usfm(spark: SparkSession, path: str) -> DataFrame:
    r"""Verses of USFM files: \c opens a chapter, \v a verse, other lines go on with it."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    upto = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    number = lambda tag: F.regexp_extract("line", rf"^\\{tag} (\d+)", 1).try_cast("int")
    lines = lines.withColumn("chapter", F.last(number("c"), ignorenulls=True).over(upto))
    opened = F.struct("n", number("v").alias("verse"))
    lines = lines.withColumn("at", F.last(F.when(number("v").isNotNull() | number("c").isNotNull(), opened), ignorenulls=True).over(upto)).where("at.verse IS NOT NULL")
    body = F.when(number("v").isNotNull(), F.regexp_replace("line", r"^\\v \d+\s*", "")).otherwise(F.regexp_replace("line", r"^\\(p|q|m|li)\d*\s*", ""))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", body.alias("b")))), lambda x: x["b"])
    got = lines.groupBy("path", "chapter", F.col("at.verse").alias("verse"), F.col("at.n").alias("n")).agg(F.array_join(parts, " ").alias("raw"))
    return got.select("path", "chapter", "verse", clean_usfm(F.col("raw")).alias("text")).where("text <> ''")


def verse_lines(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """Plain verse lines (blank and # lines skipped), cut by spans (chapter, start, verses)."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#"))).alias("v"))
    rows = spans.join(F.broadcast(lines.limit(1)))  # one file is the text; the spans are its table of contents
    cut = F.slice("v", F.col("start") + 1, F.col("verses"))
    return rows.select("chapter", F.posexplode(cut).alias("i", "text")).select("chapter", (F.col("i") + 1).alias("verse"), "text")


def chapter_spans(spark: SparkSession, path: str, tag: str = "sura") -> DataFrame:
    """Chapter metadata of an XML table of contents: chapter, start, verses, name."""
    got = spark.read.format("xml").option("rowTag", tag).load(path)
    return got.select(F.col("_index").cast("int").alias("chapter"), F.col("_start").cast("int").alias("start"), F.col("_ayas").cast("int").alias("verses"), F.col("_tname").alias("name"))


def verse_groups(spans: DataFrame, most: int = 40) -> DataFrame:
    """Greedy groups of (chapter, first, last) spans: extended while at most ``most`` verses."""
    one = "struct<first:int,last:int>"
    start = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.lit(None).cast(one).alias("open"))

    def step(s, x):
        joined = F.struct(s["open"]["first"].alias("first"), x["last"].alias("last")).cast(one)
        fits = s["open"].isNotNull() & (x["last"] - s["open"]["first"] + 1 <= most)
        done = F.when(s["open"].isNull() | fits, s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(x.cast(one)).alias("open"))

    rows = spans.groupBy("chapter").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")))).alias("s"))
    groups = F.aggregate("s", start, step, lambda s: F.array_append(s["done"], s["open"]))
    return rows.select("chapter", F.explode(groups).alias("g")).select("chapter", "g.first", "g.last")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, content of every file in every archive; corrupt archives fail."""

    def unpack(frames):
        for pdf in frames:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    if bad := z.testzip():
                        raise ValueError(f"{p}: {bad} is corrupt")
                    out += [(p, i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(out, columns=["path", "name", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "path string, name string, size long, content binary")


def markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the table whose header holds ``columns``, in a Markdown file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim("line").startswith("|")).select("n", cells.alias("c"))
    head = rows.where(F.size(F.array_intersect("c", F.array(*map(F.lit, columns)))) == len(columns)).orderBy("n").limit(1).select(F.col("n").alias("h"), F.col("c").alias("names"))
    gap = lines.where(~F.trim("line").startswith("|")).select(F.col("n").alias("g"))
    stop = head.join(gap, F.col("g") > F.col("h"), "left").groupBy("h", "names").agg(F.coalesce(F.min("g"), F.lit(2**31 - 1)).alias("stop"))
    body = rows.join(F.broadcast(stop)).where("n > h + 1 AND n < stop")
    return body.select(*[F.get("c", F.array_position("names", x).cast("int") - 1).alias(x) for x in columns])


def event_log(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """Line-delimited JSON events; bad lines are dropped, or fail if not tolerant."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
