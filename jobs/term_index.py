"""Build the page store and its fielded term index from a table of documents.

    python -m jobs.term_index --documents PATH --out PATH [--config FILE]

A document is a section: its lines are verses, gathered into pages of about ``page_chars``
characters. ``out/pages`` (partitioned by source) holds their ids, references and texts,
``out/index`` the postings (partitioned by bucket of the term) and totals that
``tessera.operators.termindex.search`` reads. Every run writes both anew from the whole table; of
a run that was broken off, another run leaves nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval, termindex

log = logging.getLogger("jobs.term_index")
CONFIG = Path(__file__).with_suffix(".json")


def config(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def pages(documents: DataFrame, chars: int) -> DataFrame:
    """(page, source, book, ref, text): page ids are ``<doc_id>:p<number>``, with two digits at
    least; a reference names the book and the first and last verse. Documents without a line that
    is not blank have no page; a null id, source or language is the text ``none``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    docs = documents.select(F.struct(name("doc_id").alias("doc"), name("source").alias("source"), name("lang").alias("lang")).alias("section"), "text")
    rows = retrieval.pages(docs, chars)
    book = F.concat_ws(" ", "section.source", "section.lang")
    page = F.format_string("%s:p%02d", "section.doc", "page_no")
    return rows.select(page.alias("page"), "section.source", book.alias("book"), F.format_string("%s %s:%d-%d", book, "section.doc", "first_verse", "last_verse").alias("ref"), "text")


def run(spark: SparkSession, documents: str, out: str, conf: dict | None = None) -> dict:
    """Writes ``out``; the numbers of rows read and written."""
    conf = conf or config()
    docs = spark.read.parquet(documents)
    made = pages(docs, conf["page_chars"])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", None)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")  # what an earlier run wrote goes
    try:
        made.repartition("source", F.pmod(F.xxhash64("page"), F.lit(conf["parts"]))).write.mode("overwrite").partitionBy("source").parquet(f"{out}/pages")
        stored = spark.read.schema(made.schema).parquet(f"{out}/pages").select("page", *conf["fields"])
        termindex.write(stored, f"{out}/index", list(conf["fields"]), "page", conf["buckets"], conf["parts"])
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode") if before is None else spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    done = {"documents": docs.count(), "pages": stored.count(), "postings": termindex.read(spark, f"{out}/index").count()}
    log.info("read %d documents from %s", done["documents"], documents)
    log.info("wrote %d pages and %d postings to %s", done["pages"], done["postings"], out)
    return done


def search(spark: SparkSession, out: str, queries: DataFrame, k: int = 8, conf: dict | None = None) -> DataFrame:
    """The best pages for (query, phrase), with the weights of the config."""
    return termindex.search(spark, f"{out}/index", queries, (conf or config())["fields"], k)


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=CONFIG)
    got = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("term_index").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, got.documents, got.out, config(got.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
