"""Adapter views that give the star-schema test tables the shape of cases, judges, citations and responses.

The SQL is the same for Spark and DuckDB; in ``RESPONSES`` a backslash is doubled for Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JUDGES = """
SELECT s_suppkey AS judge_id, s_name AS last_name, n_name AS court_name, 'District Court' AS court_type,
       TIMESTAMP '1994-01-01 00:00:00' AS nomination_date
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT s_suppkey, s_name, n_name, 'Court of Appeals',
       CASE WHEN s_suppkey % 8 = 0 THEN TIMESTAMP '1998-06-30 00:00:00'
            WHEN s_suppkey % 8 = 4 THEN TIMESTAMP '1999-11-15 00:00:00' END
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0
"""

CASES = """
SELECT 'all' AS circuit, o.o_orderkey AS unique_id, o.o_orderkey AS doc, o.o_orderkey AS ord,
       CASE WHEN o.o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS is_appellate,
       l.judge_id AS district_judge_id, l.judge_id AS opinion_author_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'Affirmed' WHEN 'O' THEN 'reversed' END AS opinion,
       o.o_orderdate AS decision_date,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            ELSE 'Nos. ' || CAST(o.o_orderkey % 997 AS VARCHAR(20)) || '-cv; ' || CAST(o.o_orderkey % 13 AS VARCHAR(20)) END AS docket_number,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Majority' ELSE 'dissent' END AS opinion_type,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'In re ' || p.p_name || ' ' || p.p_type
            ELSE p.p_name || ' ' || p.p_type || ' Co. v. ' || c.c_mktsegment || ' ' || c.c_name END AS name,
       'Appeal No. ' || CAST(o.o_orderkey % 13 AS VARCHAR(20)) || ' (' || c.c_name || ')' AS opinion_text,
       c.c_mktsegment || ', District Judge' AS opinion_author_raw
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN (SELECT l_orderkey, min(l_suppkey) AS judge_id, min(l_partkey) AS part_id FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN part p ON p.p_partkey = l.part_id
"""

CITES = """
SELECT CAST(l_orderkey AS VARCHAR(20)) || ' F.3d ' || CAST(l_suppkey AS VARCHAR(20)) AS cite, l_suppkey AS opinion_author_id,
       CAST(l_partkey AS VARCHAR(20)) || ' F.3d ' || CAST(l_suppkey AS VARCHAR(20)) AS cites_to FROM lineitem
"""

_RESPONSES = r"""
SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 17 = 0 THEN '{"custom_id":"x","error":{"code":"e"}}'
       WHEN o_orderkey % 19 = 0 THEN '{bad json'
       WHEN o_orderkey % 23 = 0 THEN ' '
       ELSE '{"custom_id":"CAP_' || CAST(o_orderkey AS VARCHAR(20)) || '","error":null,"response":{"body":{"choices":[{"message":{"content":"{\"opinion\":\"' || CASE o_orderstatus WHEN 'F' THEN 'affirmed' ELSE 'vacated' END || '\",\"politicality_score\":' || CAST(1 + o_orderkey % 5 AS VARCHAR(20)) || '}"}}]}}}' END AS value
FROM orders
"""
RESPONSES_DUCK = _RESPONSES
RESPONSES_SPARK = _RESPONSES.replace("\\", "\\\\")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations"]


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(sql)


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, JUDGES)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CASES)


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, CITES)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, RESPONSES_SPARK)
