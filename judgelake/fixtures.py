"""Evaluation-shaped views over the driver's tables, in SQL that Spark and DuckDB both run.

A view's text names tables as {table}; frame() binds them to Parquet files, ctes() to plain names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ITEMS = """
SELECT p_partkey AS item_id, p_name AS question, p_type AS category,
       CASE WHEN p_size <= 16 THEN 'easy' WHEN p_size <= 33 THEN 'medium' ELSE 'hard' END AS difficulty,
       p_partkey % 5 <> 0 AS has_ref,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS reference
FROM {part}
"""

VOTES = """
SELECT l_partkey AS item_id, 'm' || CAST(l_suppkey % 3 AS STRING) AS model,
       'j' || CAST(l_linenumber % 3 AS STRING) AS judge,
       CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey % 3, l_linenumber % 3
            ORDER BY l_suppkey, l_linenumber, l_orderkey, l_extendedprice) - 1 AS INT) AS run_idx,
       CASE (CASE WHEN l_orderkey % 10 < 6 THEN l_partkey % 4 ELSE l_orderkey % 4 END)
            WHEN 0 THEN 'right' WHEN 1 THEN 'wrong' WHEN 2 THEN 'partial' ELSE 'unclear' END AS correctness,
       CASE l_orderkey % 6 WHEN 0 THEN '事实有误' WHEN 1 THEN '计算不对' WHEN 2 THEN '遗漏要点'
            WHEN 3 THEN '偏题' WHEN 4 THEN 'format' ELSE NULL END AS error_type,
       CAST(1 + (CAST(l_quantity AS INT) + l_orderkey) % 5 AS DOUBLE) AS total,
       l_orderkey % 17 = 0 AS used_search
FROM {lineitem}
"""

VOTE_DIMS = """
SELECT l_partkey AS item_id, 'm' || CAST(l_suppkey % 3 AS STRING) AS model,
       'j' || CAST(l_linenumber % 3 AS STRING) AS judge, l_orderkey AS ord1, l_suppkey AS ord2,
       d.dim, d.dim_ord, d.weight,
       CASE d.dim_ord WHEN 0 THEN false
            WHEN 1 THEN l_orderkey % 11 = 0
            ELSE l_partkey % 7 = 0 OR l_orderkey % 13 = 0 END AS is_na,
       CAST(CASE d.dim_ord
            WHEN 0 THEN 1 + (CAST(l_quantity AS INT) + l_partkey) % 5
            WHEN 1 THEN CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 1 + l_orderkey % 5 END
            ELSE CASE WHEN l_partkey % 7 = 0 OR l_orderkey % 13 = 0 THEN NULL ELSE 1 + l_linenumber % 5 END
            END AS DOUBLE) AS score
FROM {lineitem} CROSS JOIN (
     SELECT 'accuracy' AS dim, 0 AS dim_ord, CAST(1.5 AS DOUBLE) AS weight
     UNION ALL SELECT 'completeness', 1, CAST(1.0 AS DOUBLE)
     UNION ALL SELECT 'safety', 2, CAST(0.5 AS DOUBLE)) d
"""

PAIR_ITEMS = "SELECT c_custkey AS item_id, c_mktsegment AS category, c_custkey % 4 = 0 AS has_ref FROM {customer}"

PAIR_VOTES = """
SELECT o_custkey AS item_id, 'm0' AS model_a, CASE WHEN o_orderstatus = 'O' THEN 'm1' ELSE 'm2' END AS model_b,
       'j' || CAST(o_orderkey % 3 AS STRING) AS judge, o_orderkey AS vote_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'ab' ELSE 'ba' END AS pres_order,
       CASE WHEN o_orderkey % 7 < 3 THEN 'a' WHEN o_orderkey % 7 < 5 THEN 'b' ELSE 'tie' END AS raw_winner
FROM {orders}
"""

QA = """
SELECT q.conv_id * 100 + q.turn AS item_id, q.text AS question, q.answer,
       CASE q.conv_id % 5 WHEN 0 THEN q.answer || '!'
            WHEN 1 THEN substring(q.answer, 1, CAST(floor(length(q.answer) / 2.0) AS INT))
            WHEN 2 THEN '408' WHEN 3 THEN b.text ELSE NULL END AS reference
FROM (SELECT conv_id, turn, role, text,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
      FROM {conversations}) q
JOIN {benchmark} b ON b.item_id = q.conv_id % 40
WHERE q.role = 'user' AND q.next_role = 'assistant'
"""

EVENTS = """
SELECT event_id, user_id AS item_id, ts, event_type AS module, value,
       CASE WHEN event_type = 'signup' THEN value ELSE NULL END AS started_at,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence
FROM {events}
"""

SKILLS = """
SELECT 'search' AS skill, '搜索' AS display, 0 AS load_ord, 'PROMO' AS category
UNION ALL SELECT 'search', '搜索', 0, 'ECONOMY' UNION ALL SELECT 'music', '音乐', 1, 'SMALL'
UNION ALL SELECT 'music', '音乐', 1, 'MEDIUM' UNION ALL SELECT 'news', '新闻', 2, 'LARGE'
"""

HITS = """
SELECT page_id % 7 AS query_id, page_id % 3 AS provider_ord,
       CAST(row_number() OVER (PARTITION BY page_id % 7, page_id % 3 ORDER BY page_id, url) AS INT) AS rank,
       CASE WHEN page_id % 4 = 0 THEN NULL ELSE split_part(url, '?', 1) END AS url,
       'page ' || CAST(page_id % 11 AS STRING) AS title, substring(html, 1, 80) AS snippet
FROM {pages}
"""

RESULTS = """
SELECT o_orderkey AS item_id, o_custkey AS task_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'music' WHEN 2 THEN 'news' WHEN 3 THEN 'default' END AS category,
       CASE o_orderkey % 5 WHEN 0 THEN '搜索' WHEN 1 THEN '音乐' WHEN 2 THEN '新闻' WHEN 3 THEN '通用' END AS category_display,
       CASE WHEN o_orderkey % 7 = 0 THEN 'fallback_default' ELSE 'dataset' END AS category_source,
       CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS error,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'right' WHEN o_orderkey % 4 = 1 THEN 'wrong'
            WHEN o_orderkey % 4 = 2 THEN 'partial' ELSE 'unclear' END AS correctness,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) / 8 END AS total,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 5 + 1 AS DOUBLE) END AS accuracy,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 4 + 1 AS DOUBLE) END AS safety,
       CASE o_orderkey % 6 WHEN 0 THEN '事实有误' WHEN 1 THEN '计算不对' WHEN 2 THEN 'format' END AS error_type,
       o_orderkey % 9 = 0 AS low_agreement, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 = 0 END AS agree,
       o_orderkey % 3 AS a_wins, o_orderkey % 2 AS b_wins, o_orderkey % 4 AS ties, o_orderpriority AS query, o_orderstatus AS answer
FROM {orders}
"""

SNAPSHOTS = """
SELECT c_custkey AS task_id, CASE c_custkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'compare' ELSE 'on line' END AS mode,
       CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'error' END AS status,
       CASE WHEN c_custkey % 4 = 3 THEN 'boom' END AS error, CAST(1700000000 + c_custkey * 3601 AS BIGINT) AS created_at
FROM {customer}
"""

VIEWS = {"results": RESULTS, "snapshots": SNAPSHOTS, "hits": HITS, "items": ITEMS, "votes": VOTES, "vote_dims": VOTE_DIMS, "pair_items": PAIR_ITEMS, "pair_votes": PAIR_VOTES, "qa": QA, "fx_events": EVENTS, "skills": SKILLS}
TABLES = ("part", "lineitem", "orders", "customer", "conversations", "benchmark", "events", "documents", "pages", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    text = VIEWS[view]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def ctes(*views: str) -> str:
    """`name AS (...)` of each view, for a WITH clause over tables with their plain names."""
    return ",\n".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views)
