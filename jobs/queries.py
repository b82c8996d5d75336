"""The jobs as registered queries: two runs into a new folder, and what then stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import termindex
from tessera.sources.sinks import shared_folder

from . import run_watch, term_index


def job1_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        term_index.run(spark, f"{sf_dir}/documents.parquet", out)
    return termindex.read(spark, f"{out}/index").withColumn("positions", F.array_join("positions", " "))


def job2_run_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        run_watch.run(spark, f"{sf_dir}/events.parquet", out, f"{out}/checkpoint")
    return run_watch.sections(spark, out).withColumn("day", F.col("day").cast("string")).drop("ts")


QUERIES = {f.__name__: f for f in (job1_term_index, job2_run_watch)}

#: Pages of documents as the job makes them, and their tokens by field.
PAGES_SQL = r"""RECURSIVE v AS (SELECT row_number() OVER () AS k, coalesce(CAST(doc_id AS VARCHAR), 'none') AS doc, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS vs FROM documents),
w AS (SELECT * FROM v WHERE len(vs) > 0),
walk AS (SELECT k, doc, source, lang, vs, 1 AS i, 1 AS page_no, len(vs[1]) AS size FROM w
  UNION ALL SELECT k, doc, source, lang, vs, i + 1, CASE WHEN size > 0 AND size + len(vs[i + 1]) > 1200 THEN page_no + 1 ELSE page_no END,
    CASE WHEN size > 0 AND size + len(vs[i + 1]) > 1200 THEN len(vs[i + 1]) ELSE size + len(vs[i + 1]) END FROM walk WHERE i < len(vs)),
pg AS (SELECT doc || ':p' || printf('%02d', page_no) AS page, any_value(source || ' ' || lang) AS book, string_agg(vs[i], chr(10) ORDER BY i) AS text FROM walk GROUP BY k, doc, page_no),
fld AS (SELECT page, 'book' AS field, book AS text FROM pg UNION ALL SELECT page, 'text', text FROM pg),
tok AS (SELECT page, field, list_filter(regexp_split_to_array(lower(regexp_replace(translate(text, 'ٰـ', 'ا'), '\p{Mn}', '', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM fld),
len AS (SELECT page, CAST(sum(len(t)) AS INTEGER) AS length FROM tok GROUP BY 1)"""

ORACLES = {
    "job1_term_index": f"""WITH {PAGES_SQL}, occ AS (SELECT page, field, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tok)
SELECT CAST(('0x' || substr(md5(term), 1, 6))::BIGINT % 32 AS INTEGER) AS bucket, term, field, page, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions, any_value(length) AS length
FROM occ JOIN len USING (page) GROUP BY term, field, page""",
    "job2_run_watch": """WITH l AS (
  SELECT event_id, ts, user_id % 8 AS run, CASE WHEN event_type <> 'error' THEN 'done' WHEN value < 9 THEN 'empty' ELSE 'retry' END AS kind,
    coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS section, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS minted, value * 4.3::DOUBLE AS elapsed, event_type AS concept FROM events),
a AS (SELECT *, row_number() OVER o AS ord, (epoch_us(ts) - lag(epoch_us(ts)) OVER o) // 1000000 AS silent_seconds,
  CAST(sum(CAST(kind = 'empty' AS INTEGER)) OVER o AS BIGINT) AS empty, CAST(sum(CASE WHEN kind = 'done' THEN minted ELSE 0 END) OVER o AS BIGINT) AS registry
  FROM l WINDOW o AS (PARTITION BY run ORDER BY ts, event_id)),
f AS (SELECT *, min(CASE WHEN kind = 'retry' THEN ord END) OVER (PARTITION BY run, section) AS first FROM a),
u AS (SELECT *, count(*) OVER (PARTITION BY run, concept ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM f WHERE kind = 'done'),
m AS (SELECT run, event_id, ts, ord, empty, registry, silent_seconds, row_number() OVER o AS done, max(used) OVER o AS stop,
  CAST(sum(minted) OVER (PARTITION BY run ORDER BY ts, event_id ROWS 99 PRECEDING) AS BIGINT) AS mint,
  round(median(elapsed) OVER (PARTITION BY run ORDER BY ts, event_id ROWS 19 PRECEDING), 4) AS pace,
  list({'s': section, 'f': first}) OVER (PARTITION BY run ORDER BY ts, event_id ROWS 99 PRECEDING) AS last FROM u WINDOW o AS (PARTITION BY run ORDER BY ts, event_id)),
x AS (SELECT run, event_id, CAST(ts AS DATE) AS day, done, empty, registry, silent_seconds, mint, pace, stop, len(list_distinct(list_transform(last, lambda x: x.s))) AS recent,
  len(list_distinct(list_transform(list_filter(last, lambda x: x.f < ord), lambda x: x.s))) AS retried, CAST(empty AS DOUBLE) / (done + empty) AS rate FROM m),
y AS (SELECT *, concat_ws(',', CASE WHEN silent_seconds > 14400 THEN 'A1' END, CASE WHEN done + empty >= 30 AND rate > 0.05::DOUBLE THEN 'A2' END,
  CASE WHEN registry > 2000 OR (done >= 150 AND mint > 33) THEN 'A3' END, CASE WHEN done >= 20 AND pace > 300 THEN 'A4' END,
  CASE WHEN done + empty >= 30 AND rate > 0.02::DOUBLE AND rate <= 0.05::DOUBLE THEN 'W0' END, CASE WHEN done >= 60 AND CAST(stop AS DOUBLE) / done > 0.275::DOUBLE THEN 'W1' END,
  CASE WHEN done >= 30 AND CAST(retried AS DOUBLE) / recent > 0.55::DOUBLE THEN 'W2' END, CASE WHEN done >= 20 AND pace > 150 AND pace <= 300 THEN 'W3' END) AS findings FROM x)
SELECT run, event_id, CAST(day AS VARCHAR) AS day, done, empty, registry, silent_seconds, mint, pace, stop, recent, retried, findings,
  CASE WHEN contains(findings, 'A') THEN 2 WHEN findings <> '' THEN 1 ELSE 0 END AS level FROM y""",
}
