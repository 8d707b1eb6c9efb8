"""Fact tables derived from relational tables, to run the operators at any scale.

Each is SQL that Spark and other engines read alike, over whole tables. A customer is a
method that calls, for each line it ordered, an interface named by the part's brand, type
and size; a part is a class that implements it. Users, customers, documents and pages
produce, write, cache and provide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.facts import Facts

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)

_IFACE = "p_brand || '/' || p_type || '/' || CAST(p_size AS STRING)"

#: Fact views by name; later ones may use earlier ones.
VIEWS: dict[str, str] = {
    "calls": f"""SELECT 'c' || CAST(o_custkey AS STRING) || '::order' AS caller, {_IFACE} || '::get' AS callee,
        l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "implements": f"SELECT 'p' || CAST(p_partkey AS STRING) AS class, {_IFACE} AS iface FROM part",
    "methods": """SELECT 'p' || CAST(p_partkey AS STRING) || '::get' AS fqn, 'get' AS name, 'part/' || p_brand AS file_path,
        CAST(p_partkey AS INT) AS line_start, CAST(p_partkey + p_size AS INT) AS line_end FROM part
        UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) || '::order', 'order', 'customer/' || c_mktsegment,
        CAST(c_custkey AS INT), CAST(c_custkey + 9 AS INT) FROM customer""",
    "kafka": """SELECT 'u' || CAST(user_id AS STRING) AS fqn, CASE WHEN event_id % 2 = 0 THEN 'Produce' ELSE 'Consume' END AS op,
        event_type || '-' || CAST(CAST(ts AS DATE) AS STRING) AS topic, CAST(event_id AS INT) AS line FROM events""",
    "db": """SELECT 'c' || CAST(o_custkey AS STRING) || '::order' AS fqn,
        CASE o_orderstatus WHEN 'O' THEN 'Insert' WHEN 'F' THEN 'Select' ELSE 'Update' END AS op,
        o_orderpriority || '-' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS "table",
        CAST(o_orderkey AS INT) AS line FROM orders""",
    "redis": """SELECT 'd' || CAST(doc_id AS STRING) AS fqn,
        CASE doc_id % 3 WHEN 0 THEN 'Get' WHEN 1 THEN 'Set' ELSE 'Delete' END AS op, source || ':*' AS key_pattern,
        CAST(doc_id AS INT) AS line FROM documents""",
    "http": """SELECT 'g' || CAST(page_id AS STRING) AS fqn, 'GET' AS method,
        '/' || split_part(split_part(url, '/', 4), '?', 1) AS path, page_id % 2 = 1 AS is_feign_client FROM pages""",
    "chain": """SELECT 'o' || CAST(o_orderkey AS STRING) || '::run' AS caller, 'o' || CAST(nxt AS STRING) || '::run' AS callee, 1 AS line
        FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nxt
              FROM orders) x WHERE nxt IS NOT NULL""",
    "loops": """SELECT caller, callee FROM chain UNION ALL
        SELECT 'o' || CAST(last AS STRING) || '::run', 'o' || CAST(first AS STRING) || '::run' FROM (
          SELECT o_custkey, o_orderpriority, min(first) AS first, min(last) AS last, min(ended) AS ended FROM (
            SELECT o_custkey, o_orderpriority,
              first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS first,
              first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS last,
              first_value(o_orderstatus) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS ended
            FROM orders) y GROUP BY o_custkey, o_orderpriority) z WHERE ended = 'F'""",
    "chain_methods": "SELECT 'o' || CAST(o_orderkey AS STRING) || '::run' AS fqn FROM orders",
    "chain_seeds": "SELECT 'o' || CAST(o_orderkey AS STRING) || '::run' AS fqn FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 490000",
    "config": """SELECT 'http' AS kind, 'GET' AS http_method, '/' || split_part(split_part(url, '/', 4), '?', 1) AS value FROM pages
        UNION SELECT 'kafka', CAST(NULL AS STRING), event_type || '-' || CAST(CAST(ts AS DATE) AS STRING) FROM events WHERE event_type = 'click'
        UNION SELECT 'db', CAST(NULL AS STRING), o_orderpriority || '-' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) FROM orders WHERE o_orderstatus = 'P'
        UNION SELECT 'redis', CAST(NULL AS STRING), source || ':' || lang FROM documents""",
    "hunks": """SELECT 'part/' || p_brand AS file_path, CAST(p_partkey + l_linenumber AS INT) AS new_start,
        CAST(floor(l_quantity / 10) AS INT) AS new_lines FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

#: The operators' views that come before another view in its SQL.
NEEDS = {"loops": ["chain"]}


def sql(name: str) -> str:
    return VIEWS[name].replace('"table"', "`table`")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact view over the tables of a folder."""
    for t in TABLES:
        if f" {t}" in VIEWS[name] or name in NEEDS:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for other in NEEDS.get(name, []):
        spark.sql(sql(other)).createOrReplaceTempView(other)
    return spark.sql(sql(name))


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    v = lambda n: view(spark, sf_dir, n)
    return Facts(v("methods"), v("calls"), v("http"), v("kafka"), v("db"), v("redis"), v("implements"))


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the views of these names, for another engine."""
    todo = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    body = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in todo)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
