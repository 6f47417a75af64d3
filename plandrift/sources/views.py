"""Views over the driver's tables that stand for drawings: a tag sheet, document lines, revision pairs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tag sheet: two revisions of pages of tags, with the edit between them known for each (page_number, seq).
#: The same text runs in Spark and in DuckDB.
TAG_SHEET = """
with base as (
 select l_orderkey as page_number,
  cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,
       l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) as int) as seq,
  l_partkey, l_suppkey, cast(l_quantity as int) as qty, p_name
 from lineitem join part on p_partkey = l_partkey),
e as (
 select page_number, seq, cast((l_partkey+seq)%10 as int) as edit,
  case seq%4 when 1 then concat(cast(10+l_suppkey%90 as varchar(20)),'-PIT-',cast(1000+l_partkey%9000 as varchar(20)))
             when 2 then concat('HH ',cast(qty*5 as varchar(20)))
             when 3 then concat(cast(2+l_suppkey%8 as varchar(20)),'"PG-',cast(1000+l_partkey%9000 as varchar(20)),'-A1')
             else concat('NOTE ',cast(seq as varchar(20)),': ',p_name) end as text_a,
  case seq%4 when 1 then concat(cast(10+l_suppkey%90 as varchar(20)),'-PIT-',cast(1001+l_partkey%9000 as varchar(20)))
             when 2 then concat('HH ',cast(qty*5+5 as varchar(20)))
             when 3 then concat(cast(2+l_suppkey%8 as varchar(20)),'"PG-',cast(1001+l_partkey%9000 as varchar(20)),'-A1')
             else concat('NOTE ',cast(seq as varchar(20)),': ',p_name,' rev 2') end as text_m,
  cast((l_partkey*37)%850 as double)/1000 as x0,
  cast((l_suppkey*53+seq*71)%950 as double)/1000 as y0
 from base)
select 'A' as rev, page_number, seq, edit, text_a as raw_text, x0, y0,
       x0+cast(0.08 as double) as x1, y0+cast(0.015 as double) as y1 from e where edit<>1
union all
select 'B', page_number, seq, edit, case when edit in (2,4) then text_m else text_a end,
       x0+case when edit in (3,4) then cast(0.05 as double) else cast(0 as double) end, y0,
       x0+cast(0.08 as double)+case when edit in (3,4) then cast(0.05 as double) else cast(0 as double) end,
       y0+cast(0.015 as double) from e where edit<>0
"""

#: Revision pairs among documents: the two smallest doc_ids of different texts with one beginning.
DOCUMENT_PAIRS = """
with f as (select substr(text, 1, 60) as head, min(doc_id) as doc_a from documents group by 1),
g as (select f.doc_a, min(d.doc_id) as doc_b from f join documents a on a.doc_id = f.doc_a
      join documents d on substr(d.text, 1, 60) = f.head and d.doc_id > f.doc_a and d.text <> a.text group by f.doc_a)
select g.doc_a, g.doc_b, a.text as text_a, b.text as text_b, a.source as source_a, b.source as source_b
from g join documents a on a.doc_id = g.doc_a join documents b on b.doc_id = g.doc_b
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    """text over the tables named, without touching the session's views."""
    frames = {t: read(spark, sf_dir, t) for t in tables}
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(tables)})\b", r"\1 {\2}", text), **frames)


def tag_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, TAG_SHEET, ("lineitem", "part"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, DOCUMENT_PAIRS, ("documents",))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of each document, with a box by its place and length."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    rows = lines.select("doc_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "raw_text"))
    return rows.select(
        "doc_id",
        (F.col("at") + 1).alias("line_no"),
        "n_lines",
        "raw_text",
        F.lit(0.05).alias("x0"),
        (F.col("at") / F.col("n_lines")).alias("y0"),
        F.least(F.lit(0.95), F.lit(0.05) + F.length("raw_text") / F.lit(400.0)).alias("x1"),
        ((F.col("at") + 1) / F.col("n_lines")).alias("y1"),
    )
