"""The engine's inputs, derived from the benchmark tables.

Each input is one SELECT that Spark and DuckDB read alike; `{name}` stands for a table. Operators run
on the DataFrames that these give; the checking SQL of a query starts from the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.mdx' WHEN 2 THEN '.rst' WHEN 3 THEN '.adoc' WHEN 4 THEN '.txt' ELSE '.org' END"
_STEM = f"""CASE WHEN doc_id % 19 = 0 THEN 'vendor/' ELSE '' END || coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/'
  || CASE WHEN doc_id % 23 = 0 THEN 'd' || CAST(doc_id AS STRING) || '/README' ELSE 'doc-' || CAST(doc_id AS STRING) || {_EXT} END"""

#: W1: entries of both snapshots. Some documents come, go, move or change.
ENTRIES = f"""
SELECT doc_id, 0 AS side, {_STEM} AS path, '100644' AS mode, md5(coalesce(text, '')) AS oid, CAST(length(coalesce(text, '')) AS BIGINT) AS bytes
FROM {{documents}} WHERE doc_id % 11 <> 0
UNION ALL
SELECT doc_id, 1 AS side, CASE WHEN doc_id % 17 = 0 THEN 'moved/' ELSE '' END || {_STEM} AS path,
  CASE WHEN doc_id % 29 = 0 THEN '120000' ELSE '100644' END AS mode,
  md5(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS oid, CAST(length(coalesce(text, '')) AS BIGINT) AS bytes
FROM {{documents}} WHERE doc_id % 13 <> 0
"""

#: W3: references; a document is an order, a construct a line number, a target a part.
REFS = """
SELECT document, target, construct, CAST(document AS STRING) || ':' || target || ':' || CAST(construct AS STRING) || ':' || CAST(n AS STRING) AS id
FROM (SELECT l_orderkey AS document, 't/' || CAST(l_partkey AS STRING) AS target, l_linenumber AS construct,
        row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber
                           ORDER BY l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_suppkey, l_returnflag, l_linestatus) AS n
      FROM {lineitem}) AS numbered
"""
_SIDES = {0: (5, 11, "'d'"), 1: (7, 10, "CASE WHEN p_partkey % 6 = 0 THEN 'e' ELSE 'd' END")}


def targets(side: int) -> str:
    """Entries that references of a side may name."""
    _, gone, digest = _SIDES[side]
    return f"""
SELECT 't/' || CAST(p_partkey AS STRING) AS path,
  CASE WHEN p_partkey % 97 = 0 THEN '120000' WHEN p_partkey % 89 = 0 THEN '040000' ELSE '100644' END AS mode,
  {digest} || CAST(p_partkey AS STRING) AS oid
FROM {{part}} WHERE p_partkey % {gone} <> 0
"""


def side_refs(side: int) -> str:
    drop = _SIDES[side][0]
    changed = "CASE WHEN document % 4 = 0 THEN 1 ELSE 0 END" if side else "0"
    return f"""
SELECT id, document, target, construct, document * 32 + construct * 2 + {changed} AS block,
  CASE construct WHEN 6 THEN 'external' WHEN 4 THEN 'site-route' ELSE 'path' END AS intent
FROM ({REFS}) AS refs WHERE construct % {drop} <> 0
"""


def observations(side: int) -> str:
    """What the resolver gives for a side, as SQL."""
    return f"""
SELECT r.id, r.document, r.target, r.construct, r.block, r.intent,
  CASE WHEN r.intent = 'external' THEN 'external' WHEN r.intent = 'site-route' THEN 'unsupported-semantics'
       WHEN t.path IS NULL THEN 'missing' WHEN t.mode = '120000' THEN 'unsupported-target'
       WHEN t.mode = '040000' THEN 'type-mismatch' ELSE 'resolved' END AS resolution,
  CASE WHEN r.intent = 'path' AND t.mode = '100644' THEN t.oid END AS projection
FROM ({side_refs(side)}) AS r LEFT JOIN ({targets(side)}) AS t ON t.path = r.target
"""


#: W4: deliveries.
DELIVERIES = """
SELECT event_id, CAST(user_id AS STRING) || '-' || event_type AS key, event_type, user_id, unix_timestamp(ts) AS received,
  unix_timestamp(ts) - CAST(floor(value) AS BIGINT) AS issued, md5(coalesce(props, '')) AS digest
FROM {events}
"""
#: W6: external destinations of both sides.
DESTINATIONS = """
SELECT url AS destination, 'page-' || CAST(page_id % 50 AS STRING) AS document, 0 AS side FROM {pages} WHERE page_id % 3 <> 0 AND url IS NOT NULL
UNION ALL
SELECT url AS destination, 'page-' || CAST(page_id % 40 AS STRING) AS document, 1 AS side FROM {pages} WHERE page_id % 4 <> 0 AND url IS NOT NULL
"""


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The DataFrame of a workload over the tables of sf_dir."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(text: str) -> str:
    """The same text for DuckDB."""
    text = re.sub(r"unix_timestamp\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)
