"""The tables the queries run on: the supplied ones, and dirty or typed views of them in portable SQL.

The supplied tables hold no nulls, no repeated rows and no format problems, so the quality and cleaning operators
need dirt. The views put it in: some cells become null, lower case or padded, every fiftieth row appears twice, and
five empty rows are added. Each view covers its whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_DIRTY = """
WITH d AS (
 SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20
       ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 17 = 0 THEN concat('  ', o_orderpriority)
       WHEN o_orderkey % 19 = 0 THEN concat(o_orderpriority, ' ')
       WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority)
       ELSE o_orderpriority END AS o_orderpriority,
  o_orderdate
 FROM orders)
SELECT * FROM d
UNION ALL SELECT * FROM d WHERE o_orderkey % 50 = 0
UNION ALL SELECT CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING),
                 CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS {TS}) FROM region
"""

EVENTS_TEXT = """
SELECT CAST(event_id AS STRING) AS event_id, CAST(CAST(ts AS DATE) AS STRING) AS created_date,
 CASE WHEN event_id % 10 < 6 THEN CAST(user_id AS STRING) ELSE concat('u', CAST(user_id AS STRING)) END AS user_ref,
 event_type,
 CASE WHEN event_type = 'error' THEN 'yes' ELSE 'no' END AS error_flag,
 CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS value_text
FROM events
"""

DOCS_LABELED = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

LLM_RESPONSES = """
SELECT item_id, CASE item_id % 4
  WHEN 0 THEN j
  WHEN 1 THEN concat('```json', chr(10), j, chr(10), '```')
  WHEN 2 THEN concat('Here is the report: ', j, ' Hope it helps.')
  ELSE concat('No JSON here: ', text) END AS response
FROM (SELECT item_id, text,
  concat('{"dataset_overview": "item ', CAST(item_id AS STRING), '", "key_metrics": {"total_records": "',
         CAST(length(text) AS STRING), '", "mean_length": "', CAST(item_id % 7 AS STRING),
         '"}, "insights": [{"title": "len", "description": "long", "impact": "high", "category": "distribution"}',
         CASE WHEN item_id % 3 = 0 THEN ', {"description": "untitled"}' ELSE '' END,
         '], "anomalies": [',
         CASE WHEN item_id % 5 < 2 THEN concat('{"title": "gap ', CAST(item_id % 5 AS STRING),
              '", "description": "holes", "severity": "low", "affected_columns": ["a", "b', CAST(item_id % 11 AS STRING), '"]}') ELSE '' END,
         CASE WHEN item_id % 5 = 0 THEN ', {"severity": "high"}' ELSE '' END,
         '], "recommendations": [{"action": "check ', CAST(item_id AS STRING), '", "rationale": "because", "priority": "high"}, {"action": "drop"}]',
         CASE WHEN item_id % 6 = 0 THEN '' ELSE ', "other": 1' END, '}') AS j
  FROM benchmark) t
"""

# Turns with holes between them, and turns of a tool between questions and answers.
CONVERSATIONS_GAPS = """
SELECT conv_id, turn * 10 AS turn, role, text FROM conversations
UNION ALL SELECT conv_id, turn * 10 + 5, 'tool', 'looked up' FROM conversations WHERE role = 'user' AND turn % 4 = 1
"""

VIEWS = {
    "conversations_gaps": (CONVERSATIONS_GAPS, ["conversations"]),
    "orders_dirty": (ORDERS_DIRTY, ["orders", "region"]),
    "events_text": (EVENTS_TEXT, ["events"]),
    "docs_labeled": (DOCS_LABELED, ["documents", "labels"]),
    "llm_responses": (LLM_RESPONSES, ["benchmark"]),
}

# The views' schemas as (name, storage type); the oracle SQL is built from them.
COLUMNS = {
    "orders_dirty": [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderpriority", "string"),
        ("o_orderdate", "timestamp_ntz"),
    ],
    "events_text": [
        (c, "string") for c in ("event_id", "created_date", "user_ref", "event_type", "error_flag", "value_text")
    ],
    "docs_labeled": [
        ("doc_id", "bigint"),
        ("lang", "string"),
        ("source", "string"),
        ("n_chars", "bigint"),
        ("toxic", "int"),
        ("quality", "int"),
    ],
    "part": [
        ("p_partkey", "bigint"),
        ("p_name", "string"),
        ("p_brand", "string"),
        ("p_type", "string"),
        ("p_size", "int"),
        ("p_retailprice", "double"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"),
        ("l_partkey", "bigint"),
        ("l_suppkey", "bigint"),
        ("l_linenumber", "int"),
        ("l_quantity", "double"),
        ("l_extendedprice", "double"),
        ("l_discount", "double"),
        ("l_tax", "double"),
        ("l_returnflag", "string"),
        ("l_linestatus", "string"),
        ("l_shipdate", "timestamp_ntz"),
    ],
    "events": [
        ("event_id", "bigint"),
        ("ts", "timestamp_ntz"),
        ("user_id", "bigint"),
        ("event_type", "string"),
        ("value", "double"),
        ("props", "string"),
    ],
    "documents": [
        ("doc_id", "bigint"),
        ("text", "string"),
        ("lang", "string"),
        ("source", "string"),
        ("n_chars", "bigint"),
    ],
    "orders": [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"),
    ],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table, or a derived view of supplied tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    sql, bases = VIEWS[name]
    for base in bases:
        table(spark, folder, base).createOrReplaceTempView(base)
    return spark.sql(sql.replace("{TS}", "TIMESTAMP_NTZ"))


def view_sql(name: str) -> str:
    """The view as a CTE for the oracle, or nothing for a supplied table."""
    if name not in VIEWS:
        return ""
    return f"{name} AS ({VIEWS[name][0].strip().replace('{TS}', 'TIMESTAMP')})"
