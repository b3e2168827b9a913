"""Input tables of the registered queries, derived from the given Parquet tables.

Every text below reads its source tables whole and runs in Spark and in DuckDB;
``{explode:...}`` marks the few expressions the two engines spell differently.
Pending orders become rows of blank cells, so blank-row handling is the
operators' own work and no source row is filtered away.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.durable import durable

TABLES = ["orders", "lineitem", "documents", "events", "customer", "part", "supplier", "pages", "conversations"]

CELLS = """
SELECT workbook_id, sheet_id, kind, r, c,
  CASE WHEN raw IS NULL THEN 'null' ELSE raw END AS vtype,
  CASE WHEN raw IN ('string', 'date', 'error') THEN txt END AS vtext,
  CASE WHEN raw = 'number' THEN num END AS vnum,
  CASE WHEN raw = 'boolean' THEN st = 'F' END AS vbool,
  CASE WHEN blank THEN NULL
       WHEN c = 3 AND r % 4 = 0 THEN '=SUM(B' || CAST(r AS STRING) || ':C' || CAST(r AS STRING) || ')'
       WHEN c = 3 AND r % 10 = 1 THEN '=IF(A1>0,IF(B1>0,1,0),0)'
       WHEN c = 2 AND r % 9 = 0 THEN '=VLOOKUP(A1,$D$1:$E$9,2)'
       WHEN c = 4 AND r % 16 = 5 THEN '{=A1*B1}' END AS formula,
  CASE WHEN r = 1 THEN '{"font":{"bold":true}}' WHEN c = 3 THEN '{"number_format":"0.00"}'
       WHEN r % 3 = 0 THEN '{"fill":{"color":"FFCCCCCC","type":"solid"}}' END AS style,
  r = 1 AS bold, CASE WHEN c = 1 THEN CAST(ok % 5 AS INT) ELSE 0 END AS indent,
  c = 4 AND ok % 17 = 0 AS has_comment
FROM (
  SELECT *,
    CASE WHEN blank AND c = 1 AND ok % 4 = 0 THEN 'string' WHEN blank THEN NULL
         WHEN lab AND c = 1 THEN 'string' WHEN lab THEN NULL
         WHEN head THEN 'string'
         WHEN c = 1 AND kind = 2 THEN 'number' WHEN c = 1 THEN 'string'
         WHEN c = 2 AND kind = 3 AND r <= 5 THEN 'date' WHEN c = 2 THEN 'number'
         WHEN c = 3 AND ok % 5 = 0 THEN NULL WHEN c = 3 THEN 'number'
         WHEN c = 4 THEN 'date'
         WHEN ok % 11 = 0 THEN NULL WHEN ok % 13 = 0 THEN 'error' WHEN kind = 1 THEN 'boolean' ELSE 'string' END AS raw,
    CASE WHEN blank THEN '  ' WHEN lab THEN CASE WHEN r % 16 = 0 THEN 'Total current assets' ELSE 'Equity and debt' END
         WHEN head THEN 'Region ' || prio WHEN c = 1 THEN prio WHEN c = 2 THEN '2025-05-31'
         WHEN c = 4 THEN CAST(CAST(dt AS DATE) AS STRING) WHEN ok % 13 = 0 THEN '#N/A' ELSE st END AS txt,
    CASE WHEN c = 3 THEN price ELSE CAST(cust AS DOUBLE) END AS num
  FROM (
    SELECT *, st = 'P' AS blank, kind = 4 AND r % 8 = 0 AS lab,
           kind = 6 AND (r <= 2 OR r BETWEEN 8 AND 10) AS head
    FROM (
      SELECT CAST(floor(blk / 10) AS BIGINT) AS workbook_id, CAST(blk % 7 AS INT) AS kind,
        blk * 16 + CASE WHEN blk % 7 = 5 THEN CAST(floor(k / 4) AS BIGINT) ELSE 0 END AS sheet_id,
        CASE WHEN blk % 7 = 5 THEN k % 4 + 1 ELSE k + 1 END AS r, c, ok, cust, st, price, dt, prio
      FROM (
        SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS blk, CAST(o_orderkey % 64 AS INT) AS k, o_orderkey AS ok,
          o_custkey AS cust, o_orderstatus AS st, o_totalprice AS price, o_orderdate AS dt, o_orderpriority AS prio,
          {explode:1:5} AS c
        FROM orders) a) b) d) e
"""

SHEETS = """
SELECT workbook_id, sheet_id, 'Sheet ' || CAST(sheet_id AS STRING) AS name, 1 AS min_row, 1 AS min_col,
  CASE WHEN kind = 5 THEN 4 ELSE 64 END AS max_row, 8 AS max_col,
  CASE WHEN kind = 0 THEN 1 ELSE 0 END AS frozen_rows, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS frozen_cols
FROM (SELECT DISTINCT workbook_id, sheet_id, kind FROM cells) s
"""

MERGES = """
SELECT workbook_id, sheet_id, r AS r1, 1 AS c1, r AS r2, 5 AS c2 FROM cells WHERE vtext IN ('Total current assets', 'Equity and debt')
UNION ALL
SELECT workbook_id, sheet_id, 1 AS r1, 1 AS c1, 3 AS r2, 2 AS c2 FROM cells WHERE r = 1 AND c = 1 AND vtext = '1-URGENT'
"""

WIDE = """
SELECT CAST(floor(rowkey / 10) AS BIGINT) AS workbook_id, CAST(floor(rowkey / 5) AS BIGINT) AS sheet_id,
  CAST(rowkey % 5 + 1 AS INT) AS r, CAST(rn + 3 * CAST(floor(rn / 50) AS BIGINT) AS INT) AS c,
  CASE WHEN flag = 'R' THEN 'null' ELSE 'number' END AS vtype, CAST(NULL AS STRING) AS vtext,
  CASE WHEN flag = 'A' THEN CAST(1 AS DOUBLE) WHEN flag = 'N' THEN CAST(2 AS DOUBLE) END AS vnum,
  CAST(NULL AS BOOLEAN) AS vbool,
  CASE WHEN disc >= 0.095 THEN '=A1' END AS formula,
  CASE WHEN qty > 40 THEN '{"font":{"bold":true}}' END AS style
FROM (
  SELECT CASE WHEN l_suppkey % 4 < 2 THEN l_suppkey - l_suppkey % 2 ELSE l_suppkey END AS rowkey,
    l_returnflag AS flag, l_quantity AS qty, l_discount AS disc,
    row_number() OVER (PARTITION BY CASE WHEN l_suppkey % 4 < 2 THEN l_suppkey - l_suppkey % 2 ELSE l_suppkey END
      ORDER BY l_returnflag || CAST(CAST(floor(l_quantity / 4) AS INT) AS STRING), l_orderkey, l_linenumber,
               l_quantity, l_discount, l_extendedprice, l_partkey, l_shipdate, l_tax) AS rn
  FROM lineitem) t
"""

SECTIONS = """
SELECT o_orderkey * 2 AS doc_id, 1 AS page_no, 1 AS section_no,
 'Order ' || CAST(o_orderkey AS STRING) || ' revenue $' || CAST(CAST(floor(d/1000) AS BIGINT) AS STRING) || ','
 || lpad(CAST(d%1000 AS STRING),3,'0') || '.' || lpad(CAST(c2 AS STRING),2,'0')
 || ' rose ' || CAST(o_orderkey%90+1 AS STRING) || '.' || CAST(o_orderkey%10 AS STRING) || '% in Q' || CAST(o_orderkey%4+1 AS STRING)
 || ' 20' || lpad(CAST(o_orderkey%30 AS STRING),2,'0') || '; ratio ' || CAST(o_orderkey%5 AS STRING) || '.'
 || lpad(CAST(o_orderkey%100 AS STRING),2,'0') || 'x, share ' || CAST(o_orderkey%7 AS STRING) || '/' || CAST(o_orderkey%6 AS STRING)
 || ', ' || CAST(o_orderkey%3+1 AS STRING) || 'e6 units, 2nd '
 || CASE WHEN o_orderkey%4=0 THEN 'page of table section' ELSE 'item' END AS content,
 CAST(36 AS DOUBLE) AS x0, CAST(72 AS DOUBLE) AS top
FROM (SELECT o_orderkey, CAST(floor(cents/100) AS BIGINT) AS d, cents%100 AS c2
      FROM (SELECT o_orderkey, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders) p) q
UNION ALL
SELECT doc_id * 2 + 1, 1, 1, text, CAST(36 AS DOUBLE), CAST(72 AS DOUBLE) FROM documents
"""

WORDS = """
SELECT doc_id, CAST(floor(ln/40) AS INT)+1 AS page_no, CAST(ln AS INT) AS line_no, CAST(k AS INT) AS word_no, w AS text,
  CAST(6.0 AS DOUBLE)*off AS x0, CAST(12.0 AS DOUBLE)*(ln%40)+(k*7)%3 AS top,
  CAST(6.0 AS DOUBLE)*(off+length(w)) AS x1, CAST(12.0 AS DOUBLE)*(ln%40)+(k*7)%3+10 AS bottom,
  CASE WHEN ln=0 THEN CAST(16.0 AS DOUBLE) ELSE CAST(12.0 AS DOUBLE) END AS size,
  CASE WHEN ln=0 THEN 'Arial-Bold' ELSE 'Arial' END AS fontname
FROM (
  SELECT doc_id, ln, k, w, sum(length(w)+1) OVER (PARTITION BY doc_id, ln ORDER BY k) - length(w) - 1 AS off
  FROM ({words_of_lines}) s) t
WHERE length(trim(w)) > 0
"""
_WORDS_SPARK = """SELECT doc_id, ln, k, w FROM (SELECT doc_id, ln, line FROM documents LATERAL VIEW posexplode(split(text,'\\n')) a AS ln, line) l
  LATERAL VIEW posexplode(split(line,' ')) b AS k, w"""
_WORDS_DUCK = """SELECT doc_id, ln, unnest(range(0, len(ws))) AS k, unnest(ws) AS w FROM (
  SELECT doc_id, ln, string_split(line, ' ') AS ws FROM (
    SELECT doc_id, unnest(range(0, len(ls))) AS ln, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) z) y) x"""

RESPONSES = """
SELECT workbook_id, sheet_id, CASE WHEN sheet_id%11=0 THEN 'no tables in this sheet' ELSE
 '```json {"analysis_confidence": 0.' || CAST(sheet_id%10 AS STRING)
 || ', "sheet_analysis": {"structure_complexity": "' || CASE WHEN sheet_id%3=0 THEN 'complex' WHEN sheet_id%3=1 THEN 'moderate' ELSE 'simple' END
 || '", "recommended_processing": "' || CASE WHEN sheet_id%5=0 THEN 'traditional' ELSE 'ai_assisted' END
 || '"}, "tables_detected": [{"table_id": "m1", "name": "Main", "boundaries": {"start_row": ' || CAST(a AS STRING)
 || CASE WHEN sheet_id%7=0 THEN '' ELSE ', "end_row": ' || CAST(b-sheet_id%3 AS STRING) END
 || ', "start_col": 1, "end_col": 5}, "headers": {"row_headers": [{"row": ' || CAST(a AS STRING) || ', "level": 1}, {"row": ' || CAST(a+1 AS STRING)
 || ', "level": ' || CAST(1+sheet_id%2 AS STRING) || '}]}, "confidence": 0.' || CAST(sheet_id%10 AS STRING)
 || ', "complexity_indicators": ["merged_cells", "' || CASE WHEN sheet_id%2=0 THEN 'sparse_data' ELSE 'merged_cells' END || '"]}, '
 || '{"table_id": "m2", "boundaries": {"start_row": ' || CAST(a+3 AS STRING) || ', "end_row": ' || CAST(a+sheet_id%9 AS STRING)
 || ', "start_col": 2, "end_col": 4}, "confidence": 1.' || CAST(sheet_id%4 AS STRING) || '}]} ```' END AS response_text
FROM (SELECT workbook_id, sheet_id, min(r) AS a, max(r) AS b FROM cells
      WHERE vtype <> 'null' AND length(trim(coalesce(vtext, 'x'))) > 0 GROUP BY workbook_id, sheet_id) e
"""

PROCESSING = """
SELECT user_id AS processing_id, event_id AS seq, ts, event_type, value,
 CASE WHEN event_type='signup' THEN 'processing' WHEN event_type='error' THEN 'failed' WHEN event_type='purchase' THEN 'completed' END AS status,
 CASE WHEN user_id%2=0 THEN 'excel' ELSE 'pdf' END AS type, 'file-' || CAST(user_id AS STRING) AS filename
FROM events
"""

# Page texts: one page per order line block, a document per eight orders, plus one page per source document.
PAGETEXT = """
SELECT CAST(floor(doc_id / 16) AS BIGINT) * 2 AS doc_id, CAST(floor(doc_id / 2) AS BIGINT) % 8 AS page_idx, content
FROM sections WHERE doc_id % 2 = 0
UNION ALL
SELECT CAST(floor(doc_id / 16) AS BIGINT) * 2 + 1, CAST(floor(doc_id / 2) AS BIGINT) % 8, content
FROM sections WHERE doc_id % 2 = 1
"""

TEXTS = {
    "cells": (CELLS, ["orders"]),
    "sheets": (SHEETS, ["cells"]),
    "merges": (MERGES, ["cells"]),
    "wide": (WIDE, ["lineitem"]),
    "sections": (SECTIONS, ["orders", "documents"]),
    "words": (WORDS, ["documents"]),
    "responses": (RESPONSES, ["cells"]),
    "processing": (PROCESSING, ["events"]),
    "pagetext": (PAGETEXT, ["sections"]),
}


def spark_text(name: str) -> str:
    text = TEXTS[name][0].replace("{words_of_lines}", _WORDS_SPARK)
    return re.sub(r"\{explode:(\d+):(\d+)\}", r"explode(sequence(\1, \2))", text)


def duck_text(name: str) -> str:
    text = TEXTS[name][0].replace("{words_of_lines}", _WORDS_DUCK)
    return re.sub(r"\{explode:(\d+):(\d+)\}", lambda m: f"CAST(unnest(range({m[1]}, {int(m[2]) + 1})) AS INT)", text)


# Derived inputs that stand for stored tables: written once per session and folder, as a corpus would be.
STORED = {"cells", "wide", "sections"}
#: Bytes of text whose words one task takes; a word becomes a row of some 150 bytes.
TEXT_BYTES = 2 << 20
#: Rows of a file of long texts; rows of other tables are short.
TEXT_ROWS = {"sections": 10_000}
_WRITTEN: dict[tuple[str, str, str], DataFrame | int] = {}


def _stored(spark: SparkSession, folder: str, name: str, df: DataFrame) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = durable(df, TEXT_ROWS.get(name, 100_000))
    return _WRITTEN[key]


class Inputs:
    """The input tables of one data folder as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in TEXTS:
                deps = {d: self.table(d) for d in TEXTS[name][1]}
                if name == "words":
                    deps["documents"] = self.by_document(deps["documents"])
                text = spark_text(name)
                for d in deps:
                    text = re.sub(rf"\bFROM {d}\b", "FROM {" + d + "}", text)
                df = self.spark.sql(_escape(text, deps), **deps)
                self._built[name] = _stored(self.spark, self.folder, name, df) if name in STORED else df
            else:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]

    def by_document(self, df: DataFrame) -> DataFrame:
        """``df`` dealt to tasks by doc_id, always in the same way.

        Texts travel once, before they become words: windows, groups and joins on doc_id and more
        columns then find their rows in place.  Joins need the setting for that, which by default
        asks for all join columns.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, "parts of documents")
        if key not in _WRITTEN:
            self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            size = self.table("documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
            _WRITTEN[key] = max(self.spark.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))
        return df.repartition(_WRITTEN[key], "doc_id")

    def stored(self, name: str, build) -> DataFrame:
        """An intermediate that several queries read, written once like a stored table."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = durable(build())
        return _WRITTEN[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TEXTS or name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def _escape(text: str, deps: dict) -> str:
    """Double the literal braces of JSON texts so only the table names are placeholders."""
    marks = {f"{{{d}}}": f"\x00{d}\x01" for d in deps}
    for m, s in marks.items():
        text = text.replace(m, s)
    text = text.replace("{", "{{").replace("}", "}}")
    return text.replace("\x00", "{").replace("\x01", "}")


def with_ctes(needed: list[str], body: str, extra: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """A DuckDB statement: the input tables it needs as CTEs, then the body."""
    known = {**{k: (duck_text(k), TEXTS[k][1]) for k in TEXTS}, **(extra or {})}
    order: list[str] = []

    def visit(n: str) -> None:
        if n in known and n not in order:
            for d in known[n][1]:
                visit(d)
            order.append(n)

    for n in needed:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({known[n][0]})" for n in order)
    if ctes and body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return (f"WITH {ctes}\n" if ctes else "") + body
