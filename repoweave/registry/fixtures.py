"""Corpus-shaped views over the test tables.

The same SQL text runs on Spark and on DuckDB, so both sides of a check start from equal rows. ``doc_id`` runs
through the sources in turn, so the index of a document within its source is ``floor(doc_id / 20)``, and the size of a source
follows from the number of documents: no window, and no join of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_FILES = """
select d.source as repo_name,
       concat('m', d.idx, '.py') as rel_path,
       concat('repos/', d.source, '/m', d.idx, '.py') as file_path,
       concat('import os, sys', chr(10), 'from pkg.sub import y', chr(10),
              'import m', cast(floor(d.idx / 2) as bigint), ' as parent', chr(10),
              case when d.idx % 10 = 3 then concat('  from m', least(2 * d.idx, d.n - 1), ' import x', chr(10)) else '' end,
              case when d.idx % 5 = 0 then concat('import m', (d.idx + 1) % d.n, chr(10)) else '' end,
              d.text) as content
from (select source, cast(floor(doc_id / 20) as bigint) as idx, text,
             cast(floor(((select count(*) from documents) - 1 - doc_id % 20) / 20) as bigint) + 1 as n
      from documents) d
"""

# The same files spread over three folders, with each base name in more than one of them.
NESTED_FILES = """
select source as repo_name,
       concat('d', idx % 3, case when idx % 2 = 0 then '/sub' else '' end, '/m', cast(floor(idx / 4) as bigint), '_', idx % 2, '.py') as rel_path,
       concat('import m', cast(floor(idx / 8) as bigint), '_', idx % 2, chr(10),
              'from __future__ import annotations', chr(10), text) as content
from (select source, cast(floor(doc_id / 20) as bigint) as idx, text from documents) d
"""

JAVA_FILES = """
select source as repo_name, concat('J', idx, '.java') as rel_path,
       concat('repos/', source, '/J', idx, '.java') as file_path,
       concat(case when idx % 10 = 9 then repeat(concat('// c', chr(10)), 100) else '' end,
              'package p;', chr(10), 'import J', cast(floor(idx / 2) as bigint), ';', chr(10),
              'import com.x.J1;', chr(10), 'import static a.B.c;', chr(10), 'import java.util.*;', chr(10),
              ' import J2;', chr(10), 'public class J', idx, ' {', chr(10), 'import J0;', chr(10), '}', chr(10), text) as content
from (select source, cast(floor(doc_id / 20) as bigint) as idx, text from documents) d
"""

SEARCH_ITEMS = """
select p_partkey as row_ord, concat(replace(p_name, ' ', '-'), '-', p_partkey) as name,
       concat('https://host.example/', p_partkey) as html_url,
       (p_partkey * 7919) % 100003 as stars, p_partkey % 7 <> 0 as has_issues,
       cast(p_size as bigint) * 10000 as size,
       case when p_partkey % 11 = 0 then null when p_partkey % 13 = 0 then 'A Template for X'
            when p_partkey % 17 = 0 then '机器学习 课程' when p_partkey % 19 = 0 then 'latest tools'
            else p_name end as description
from part
"""

PACKAGES = """
select p_partkey as row_ord, concat('pkg', p_partkey) as project, (p_partkey * 104729) % 1000 as download_count from part
"""

# One package page per stored page; every fifth has no file card.
PACKAGE_PAGES = """
select concat('pkg', page_id) as project,
       case when page_id % 5 = 0 then html
            else replace(html, '<div class="ad">',
                 concat('<div class="card file__card"><div><b>file</b></div><span><a href="', url,
                        '">get</a></span><a href="/other">x</a></div><div class="ad">')) end as html,
       url
from pages
"""

TABLES = ("documents", "pages", "part", "benchmark", "labels", "conversations")


# Tables with long texts, and their keys. Files may have a single row group, which one task reads; then rows are dealt out by
# key right after the scan, into as many parts as shuffles have. A table whose splits keep all cores busy is not moved.
DEALT = {"documents": "doc_id", "pages": "page_id"}
# The largest split may have this many times the rows that each core has on average.
EVEN = 1.25


def is_even(df: DataFrame) -> bool:
    """Whether the rows of a scan lie in splits that all cores can share; counts come from the files' footers."""
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one row per split
    return max(rows, default=0) * df.sparkSession.sparkContext.defaultParallelism <= EVEN * sum(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in DEALT and not is_even(df):
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), DEALT[name])
    return df


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the texts above on the tables of ``sf_dir``."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if f"from {name}" in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for name in used:
        text = text.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(text, **used)
