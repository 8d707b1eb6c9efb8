"""The registered queries of the analysis operators, and the SQL that other engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import associate, cross, graph, resolve, seeds, trace
from ..operators import facts as fx
from ..parsers import patch
from ..sources import tables as tf
from . import encodings as enc
from .encodings import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Depth limit of the traces, the default of the operator.
DEPTH = 10


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# -- lookups and views

_BIG = "SELECT 'c' || CAST(c_custkey AS STRING) || '::order' AS fqn FROM customer WHERE c_acctbal > 9000"
_BRANDS = "SELECT DISTINCT p_brand || '/' || p_type || '/' || CAST(p_size AS STRING) AS iface FROM part WHERE p_retailprice > 990"


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


@query("l01_find_method", f"{with_views('methods')} SELECT m.* FROM methods m WHERE fqn IN ({_BIG})")
def find_method(s, d):
    return fx.find_method(view(s, d, "methods"), _sql(s, d, _BIG, "customer"))


@query("l02_find_callers", f"{with_views('calls')} SELECT callee, caller FROM calls WHERE callee IN (SELECT iface || '::get' FROM ({_BRANDS}) b)")
def find_callers(s, d):
    keys = _sql(s, d, _BRANDS, "part").select(F.concat("iface", F.lit("::get")).alias("callee"))
    return fx.find_callers(view(s, d, "calls"), keys)


@query("l03_find_callees", f"{with_views('calls')} SELECT caller, callee FROM calls WHERE caller IN ({_BIG})")
def find_callees(s, d):
    return fx.find_callees(view(s, d, "calls"), _sql(s, d, _BIG, "customer").withColumnRenamed("fqn", "caller"))


def _views() -> None:
    kinds = {
        "l04_http_providers": ("http", fx.http_providers, "SELECT method, path, max(fqn) AS fqn FROM http WHERE NOT is_feign_client GROUP BY 1, 2"),
        "l05_http_consumers": ("http", fx.http_consumers, "SELECT method, path, fqn FROM http WHERE is_feign_client"),
        "l06_kafka_consumers": ("kafka", fx.kafka_consumers, "SELECT topic, fqn FROM kafka WHERE op = 'Consume'"),
        "l07_kafka_producers": ("kafka", fx.kafka_producers, "SELECT topic, fqn FROM kafka WHERE op = 'Produce'"),
        "l08_db_readers": ("db", fx.db_readers, 'SELECT "table", fqn FROM db WHERE op = \'Select\''),
        "l09_db_writers": ("db", fx.db_writers, 'SELECT "table", fqn FROM db WHERE op <> \'Select\''),
        "l10_redis_readers": ("redis", fx.redis_readers, "SELECT key_pattern, fqn FROM redis WHERE op = 'Get'"),
        "l11_redis_writers": ("redis", fx.redis_writers, "SELECT key_pattern, fqn FROM redis WHERE op <> 'Get'"),
    }
    for name, (v, f, sql) in kinds.items():
        query(name, f"{with_views(v)} {sql}")(lambda s, d, v=v, f=f: f(view(s, d, v)))


_views()


@query("l12_methods", f"{with_views('methods')} SELECT * FROM methods")
def methods(s, d):
    return view(s, d, "methods")


@query("l14_interface_implementations", f"{with_views('implements')} SELECT iface, class FROM implements WHERE iface IN ({_BRANDS})")
def implementations(s, d):
    return fx.find_interface_implementations(view(s, d, "implements"), _sql(s, d, _BRANDS, "part"))


@query("l15_class_interfaces", f"{with_views('implements')} SELECT class, iface FROM implements WHERE class IN (SELECT 'p' || CAST(p_partkey AS STRING) FROM part WHERE p_size = 50)")
def interfaces(s, d):
    keys = _sql(s, d, "SELECT 'p' || CAST(p_partkey AS STRING) AS class FROM part WHERE p_size = 50", "part")
    return fx.find_class_interfaces(view(s, d, "implements"), keys)


_SINGLE = "single AS (SELECT iface, max(class) AS impl FROM implements GROUP BY iface HAVING count(*) = 1)"
_RESOLVED = """resolved AS (SELECT caller, line, CASE WHEN impl IS NOT NULL THEN impl || '::' || split_part(callee, '::', 2) ELSE callee END AS callee
    FROM calls LEFT JOIN single ON split_part(callee, '::', 1) = iface)"""


@query("l16_resolve_interface_call", f"{with_views('calls', 'implements')}, {_SINGLE}, {_RESOLVED} SELECT caller, line, callee FROM resolved")
def resolve_call(s, d):
    return resolve.resolved(view(s, d, "calls"), "callee", view(s, d, "implements")).select("caller", "line", "callee")


@query("i09_summary", f"""{with_views('methods', 'calls', 'http', 'kafka', 'db', 'redis', 'implements')}
SELECT 'methods' AS index_name, count(DISTINCT fqn) AS n FROM methods UNION ALL SELECT 'method_calls', count(DISTINCT caller) FROM calls
UNION ALL SELECT 'reverse_calls', count(DISTINCT callee) FROM calls
UNION ALL SELECT 'http_providers', count(DISTINCT method || ' ' || path) FROM http WHERE NOT is_feign_client
UNION ALL SELECT 'http_consumers', count(DISTINCT method || ' ' || path) FROM http WHERE is_feign_client
UNION ALL SELECT 'kafka_producers', count(DISTINCT topic) FROM kafka WHERE op = 'Produce'
UNION ALL SELECT 'kafka_consumers', count(DISTINCT topic) FROM kafka WHERE op = 'Consume'
UNION ALL SELECT 'db_writers', count(DISTINCT "table") FROM db WHERE op <> 'Select'
UNION ALL SELECT 'db_readers', count(DISTINCT "table") FROM db WHERE op = 'Select'
UNION ALL SELECT 'redis_writers', count(DISTINCT key_pattern) FROM redis WHERE op <> 'Get'
UNION ALL SELECT 'redis_readers', count(DISTINCT key_pattern) FROM redis WHERE op = 'Get'
UNION ALL SELECT 'interface_implementations', count(DISTINCT iface) FROM implements
UNION ALL SELECT 'class_interfaces', count(DISTINCT class) FROM implements""")  # fmt: skip
def summary(s, d):
    return fx.summary(enc.facts(s, d))


@query("i04_last_write_wins", f"""{with_views('db')} SELECT fqn, op, "table", line FROM (
SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY line DESC) AS k FROM db) x WHERE k = 1""")  # fmt: skip
def last_wins(s, d):
    return fx.last_by(view(s, d, "db"), ["fqn"], [F.col("line")]).select("fqn", "op", "table", "line")


# -- joins


@query("j01_changed_methods", f"""{with_views('methods', 'hunks')} SELECT DISTINCT fqn FROM methods m JOIN hunks h ON m.file_path = h.file_path
AND m.line_start <= h.new_start + h.new_lines AND m.line_end >= h.new_start""")  # fmt: skip
def changed(s, d):
    return seeds.changed_methods(view(s, d, "methods"), view(s, d, "hunks"))


@query("j02_missing_files", """SELECT DISTINCT 'part/' || p_name AS file_path FROM part
EXCEPT SELECT 'part/' || p_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.1""")  # fmt: skip
def missing(s, d):
    present = """SELECT 'part/' || p_name AS file_path FROM part JOIN lineitem ON l_partkey = p_partkey
        WHERE l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.1"""
    return seeds.missing_files(_sql(s, d, "SELECT 'part/' || p_name AS file_path FROM part", "part"), _sql(s, d, present, "part", "lineitem"))


@query("j03_known_callees", f"{with_views('calls', 'implements', 'methods')}, {_SINGLE}, {_RESOLVED} SELECT caller, callee, line FROM resolved WHERE callee IN (SELECT fqn FROM methods)")
def known(s, d):
    r = resolve.resolved(view(s, d, "calls"), "callee", view(s, d, "implements"))
    return resolve.known(r, "callee", view(s, d, "methods")).select("caller", "callee", "line")


@query("j04_interface_upstream", f"""{with_views('calls', 'implements', 'methods')}, p AS (SELECT DISTINCT caller, callee FROM calls),
bo AS (SELECT caller, callee FROM p UNION ALL SELECT caller, class || '::' || split_part(callee, '::', 2) FROM p JOIN implements ON iface = split_part(callee, '::', 1))
SELECT DISTINCT callee AS src, caller AS dst FROM bo WHERE caller IN (SELECT fqn FROM methods)""")  # fmt: skip
def interface_upstream(s, d):
    return resolve.upstream_steps(view(s, d, "calls"), view(s, d, "implements"), view(s, d, "methods"))


@query("j05_interface_downstream", f"""{with_views('calls', 'implements', 'methods')}, {_SINGLE}, {_RESOLVED}
SELECT DISTINCT caller AS src, callee AS dst FROM resolved WHERE callee IN (SELECT fqn FROM methods)""")  # fmt: skip
def interface_downstream(s, d):
    return resolve.downstream_steps(view(s, d, "calls"), view(s, d, "implements"), view(s, d, "methods"))


def _cross(kind: str):
    def run(s, d):
        f = fx.empty(s)
        setattr(f, kind, view(s, d, kind))
        return cross.pairs(*cross.sides(f))

    return run


_PAIRS = {
    "j06_http": ("http", """(SELECT DISTINCT 'http:' || method || ':' || path AS r, fqn FROM http WHERE is_feign_client)""",
                 """(SELECT 'http:' || method || ':' || path AS r, max(fqn) AS fqn FROM http WHERE NOT is_feign_client GROUP BY 1)"""),
    "j07_kafka": ("kafka", "(SELECT DISTINCT 'kafka:' || topic AS r, fqn FROM kafka WHERE op = 'Produce')", "(SELECT DISTINCT 'kafka:' || topic AS r, fqn FROM kafka WHERE op = 'Consume')"),
    "j08_db": ("db", """(SELECT DISTINCT 'db:' || "table" AS r, fqn FROM db WHERE op <> 'Select')""", """(SELECT DISTINCT 'db:' || "table" AS r, fqn FROM db WHERE op = 'Select')"""),
    "j09_redis": ("redis", "(SELECT DISTINCT 'redis:' || key_pattern AS r, fqn FROM redis WHERE op <> 'Get')", "(SELECT DISTINCT 'redis:' || key_pattern AS r, fqn FROM redis WHERE op = 'Get')"),
}
for _name, (_kind, _a, _p) in _PAIRS.items():
    query(_name, f"{with_views(_kind)} SELECT a.r AS resource, a.fqn AS source, p.fqn AS target FROM {_a} a JOIN {_p} p ON a.r = p.r")(_cross(_kind))


# -- configuration

_NAMED = "list_filter(string_split(value, '/'), lambda s: s <> '' AND NOT (starts_with(s, '{') AND ends_with(s, '}')))"
#: Targets that look like client calls, one for each page.
_CLIENTS = "SELECT 'g' || CAST(page_id AS STRING) AS caller, 'RestTemplate::getForObject(' || lower(url) || ')' AS callee, 1 AS line FROM pages"


@query("a01_config_http", f"""{with_views('config')}, k AS ({_CLIENTS}), e AS (SELECT DISTINCT value, {_NAMED} AS named FROM config WHERE kind = 'http')
SELECT DISTINCT 'http:GET:' || value AS config_key, caller AS fqn FROM k JOIN e
ON len(list_filter(named, lambda s: NOT contains(lower(callee), lower(s)))) = 0""")  # fmt: skip
def config_http(s, d):
    return associate.http(view(s, d, "config"), _sql(s, d, _CLIENTS, "pages"))


@query("a02_config_topics", f"{with_views('config', 'kafka')} SELECT 'kafka:topic:' || topic AS config_key, fqn FROM kafka WHERE topic IN (SELECT value FROM config WHERE kind = 'kafka')")
def config_topics(s, d):
    return associate.topics(view(s, d, "config"), view(s, d, "kafka"))


@query("a03_config_tables", f"""{with_views('config', 'db')} SELECT 'db:table:' || "table" AS config_key, fqn FROM db WHERE "table" IN (SELECT value FROM config WHERE kind = 'db')""")
def config_tables(s, d):
    return associate.tables(view(s, d, "config"), view(s, d, "db"))


@query("a04_config_keys", f"""{with_views('config', 'redis')}, c AS (SELECT DISTINCT value FROM config WHERE kind = 'redis'), k AS (SELECT DISTINCT key_pattern FROM redis)
SELECT DISTINCT 'redis:key:' || value AS config_key, fqn FROM c JOIN k ON value = key_pattern
OR (value LIKE '%*%' AND starts_with(key_pattern, rtrim(value, '*'))) OR (value NOT LIKE '%*%' AND key_pattern LIKE '%*%' AND starts_with(value, rtrim(key_pattern, '*')))
JOIN redis USING (key_pattern)""")  # fmt: skip
def config_keys(s, d):
    return associate.keys(view(s, d, "config"), view(s, d, "redis"))


@query("a00_associations", f"""{with_views('config', 'kafka', 'db', 'redis')}, t AS (
SELECT 'kafka:topic:' || topic AS config_key, fqn FROM kafka WHERE topic IN (SELECT value FROM config WHERE kind = 'kafka')
UNION ALL SELECT 'db:table:' || "table", fqn FROM db WHERE "table" IN (SELECT value FROM config WHERE kind = 'db')
UNION ALL SELECT DISTINCT 'redis:key:' || value, fqn FROM config JOIN redis ON value = key_pattern OR (key_pattern LIKE '%*%' AND value NOT LIKE '%*%' AND starts_with(value, rtrim(key_pattern, '*'))) WHERE kind = 'redis')
SELECT config_key, count(*) AS n, count(DISTINCT fqn) AS n_methods FROM t GROUP BY config_key""")  # fmt: skip
def associations(s, d):
    f = enc.facts(s, d)
    f.config_items = view(s, d, "config")
    return associate.associations(f).groupBy("config_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fqn").alias("n_methods"))


@query("l13_config_associations", f"""{with_views('config', 'db')} SELECT 'db:table:' || "table" AS config_key, fqn FROM db
WHERE "table" IN (SELECT value FROM config WHERE kind = 'db') AND "table" LIKE '1-URGENT%'""")  # fmt: skip
def config_lookup(s, d):
    c = view(s, d, "config")
    keys = c.where("kind = 'db' AND value LIKE '1-URGENT%'").select(fn.config_key("db", F.col("value")).alias("config_key"))
    return fx.lookup(associate.tables(c, view(s, d, "db")), keys, "config_key").select("config_key", "fqn")


# -- traces


def _chain_facts(s: SparkSession, d: str) -> fx.Facts:
    f = fx.empty(s)
    f.calls = view(s, d, "chain")
    f.methods = view(s, d, "chain_methods")
    return f


def _walk(down: bool) -> str:
    a, b = ("caller", "callee") if down else ("callee", "caller")
    return f"""{with_views('chain', 'chain_seeds', recursive=True)}, w AS (SELECT fqn, 0 AS depth FROM chain_seeds
    UNION SELECT c.{b}, w.depth + 1 FROM w JOIN chain c ON c.{a} = w.fqn WHERE w.depth < {DEPTH})"""


def _reach(down: bool):
    def run(s, d):
        config = trace.TraceConfig(max_depth=DEPTH, upstream=not down, downstream=down, cross_service=False)
        f = _chain_facts(s, d)
        return trace.reach(s, view(s, d, "chain_seeds"), trace.steps(f, config), config).select("fqn", F.col("depth").cast("long").alias("depth"))

    return run


for _down, _name in ((True, "t03_trace_downstream"), (False, "t02_trace_upstream")):
    query(_name, f"{_walk(_down)} SELECT fqn, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY fqn")(_reach(_down))

_CALL_EDGES = f"""{with_views('chain', 'chain_seeds', recursive=True)}, dn AS (SELECT fqn, 0 AS depth FROM chain_seeds
    UNION SELECT c.callee, depth + 1 FROM dn JOIN chain c ON c.caller = dn.fqn WHERE depth < {DEPTH}),
  up AS (SELECT fqn, 0 AS depth FROM chain_seeds UNION SELECT c.caller, depth + 1 FROM up JOIN chain c ON c.callee = up.fqn WHERE depth < {DEPTH}),
  e AS (SELECT DISTINCT 'method:' || c.caller AS src, 'method:' || c.callee AS dst, 'MethodCall' AS edge_type, 'Downstream' AS direction
        FROM dn JOIN chain c ON c.caller = dn.fqn WHERE depth < {DEPTH}
        UNION SELECT 'method:' || c.caller, 'method:' || c.callee, 'MethodCall', 'Upstream' FROM up JOIN chain c ON c.callee = up.fqn WHERE depth < {DEPTH}),
  n AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT 'method:' || fqn FROM chain_seeds)"""


def _traced(s: SparkSession, d: str):
    return trace.trace(s, _chain_facts(s, d), view(s, d, "chain_seeds"), trace.TraceConfig(max_depth=DEPTH, cross_service=False))


@query("t01_trace_impact", f"{_CALL_EDGES} SELECT * FROM e")
def trace_impact(s, d):
    return _traced(s, d)[1]


@query("g01_nodes", f"{_CALL_EDGES} SELECT id, 'method' AS kind, substr(id, 8) AS label FROM n")
def nodes(s, d):
    return _traced(s, d)[0].select("id", "kind", "label")


@query("g05_counts", f"{_CALL_EDGES} SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def node_counts(s, d):
    return graph.counts(*_traced(s, d))


_EDGE_JSON = """'{"from":"' || src || '","to":"' || dst || '","type":"method_call","direction":"' || lower(direction) || '"}'"""


@query("g07_json_edges", f"{_CALL_EDGES} SELECT {_EDGE_JSON} AS json FROM e")
def json_edges(s, d):
    return graph.json_edges(_traced(s, d)[1])


@query("g08_dot_nodes", f"""{_CALL_EDGES} SELECT id, '    "' || id || '" [ label="' || substr(id, 8) || '" shape="box" type="method" ]' AS line FROM n""")
def dot_nodes(s, d):
    return graph.dot_nodes(_traced(s, d)[0])


@query("g03_connected_edges", f"""{with_views('chain', 'chain_seeds')} SELECT caller AS src, callee AS dst FROM chain
WHERE caller IN (SELECT fqn FROM chain_seeds) AND callee IN (SELECT fqn FROM chain_seeds)""")  # fmt: skip
def connected(s, d):
    e = view(s, d, "chain").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.connected(e, view(s, d, "chain_seeds").withColumnRenamed("fqn", "id"))


@query("g06_cycles", f"""{with_views('loops', recursive=True)}, p AS (SELECT caller AS a, callee AS b FROM loops WHERE caller <> callee),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")  # fmt: skip
def cycles(s, d):
    e = view(s, d, "loops").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.cycles(e)


def _service_facts(s: SparkSession, d: str) -> fx.Facts:
    """Customers that write and read tables, and the parts they order."""
    f = fx.empty(s)
    f.methods, f.calls, f.implements, f.db = (view(s, d, n) for n in ("methods", "calls", "implements", "db"))
    return f


#: Down from writers to readers and their callees; up the other way is symmetrical.
@query("t04_trace_cross_service", f"""{with_views('calls', 'implements', 'methods', 'db', recursive=True)}, {_SINGLE}, {_RESOLVED},
dn AS (SELECT DISTINCT caller AS src, callee AS dst FROM resolved WHERE callee IN (SELECT fqn FROM methods)),
p AS (SELECT DISTINCT caller, callee FROM calls),
bo AS (SELECT caller, callee FROM p UNION ALL SELECT caller, class || '::' || split_part(callee, '::', 2) FROM p JOIN implements ON iface = split_part(callee, '::', 1)),
us AS (SELECT DISTINCT callee AS src, caller AS dst FROM bo WHERE caller IN (SELECT fqn FROM methods)),
w AS (SELECT DISTINCT "table" AS t, fqn FROM db WHERE op <> 'Select'), rd AS (SELECT DISTINCT "table" AS t, fqn FROM db WHERE op = 'Select'),
ov AS (SELECT DISTINCT w.fqn AS src, rd.fqn AS dst, 'Down' AS dir FROM w JOIN rd USING (t) UNION SELECT DISTINCT rd.fqn, w.fqn, 'Up' FROM w JOIN rd USING (t)),
st AS (SELECT src, dst, 'Down' AS dir, 'Down' AS nd, 1 AS k FROM dn UNION ALL SELECT src, dst, 'Up', 'Up', 1 FROM us
       UNION ALL SELECT src, dst, 'Down', dir, 0 FROM ov UNION ALL SELECT src, dst, 'Up', dir, 0 FROM ov),
q AS (SELECT 'c' || CAST(c_custkey AS STRING) || '::order' AS fqn, x.dir, 0 AS depth FROM customer CROSS JOIN (VALUES ('Up'), ('Down')) x(dir) WHERE c_acctbal > 9900
      UNION SELECT st.dst, st.nd, CASE WHEN st.k = 0 THEN 0 ELSE q.depth + 1 END FROM q JOIN st ON st.src = q.fqn AND st.dir = q.dir WHERE q.depth < 2)
SELECT fqn, dir, CAST(min(depth) AS BIGINT) AS depth FROM q GROUP BY 1, 2""")  # fmt: skip
def cross_service(s, d):
    text = "SELECT 'c' || CAST(c_custkey AS STRING) || '::order' AS fqn FROM customer WHERE c_acctbal > 9900"
    config = trace.TraceConfig(max_depth=2)
    found = trace.reach(s, _sql(s, d, text, "customer"), trace.steps(_service_facts(s, d), config), config)
    return found.select("fqn", "dir", F.col("depth").cast("long").alias("depth"))


# -- scalar functions, over literal texts and over whole tables

SNIPPETS = [
    (1, 'jdbc.query("SELECT id, name FROM users WHERE id = 1"); kafka.send("user-events", u)', "com.acme.UserService::find"),
    (2, 'insert into orders VALUES (1); UPDATE stock SET n = 2; delete from carts', "find"),
    (3, '@GetMapping(value = "/api/{id}/items/{item}", method = RequestMethod.POST)', "a::b::c"),
    (4, 'redis.opsForValue().get("user:*"); redis.opsForValue().set("cart:1", x); redis.delete("cart:2")', "std::fs::read"),
    (5, '@KafkaListener(topics = "order-events") consumer.subscribe(&["audit"]); select a\nfrom nowhere', ""),
]
_VALUES = ", ".join("({}, '{}', '{}')".format(i, t.replace("'", "''"), c) for i, t, c in SNIPPETS)
_SNIPPETS = f"s(id, body, target) AS (VALUES {_VALUES})"


def _snippets(s: SparkSession) -> DataFrame:
    return s.createDataFrame(SNIPPETS, "id int, body string, target string")


@query("f01_sql_operations", f"""WITH {_SNIPPETS} SELECT id, op, tbl FROM (
SELECT id, 'Select' AS op, unnest(regexp_extract_all(body, '(?i)SELECT\\s+.+?\\s+FROM\\s+(\\w+)', 1)) AS tbl FROM s
UNION ALL SELECT id, 'Insert', unnest(regexp_extract_all(body, '(?i)INSERT\\s+INTO\\s+(\\w+)', 1)) FROM s
UNION ALL SELECT id, 'Update', unnest(regexp_extract_all(body, '(?i)UPDATE\\s+(\\w+)\\s+SET', 1)) FROM s
UNION ALL SELECT id, 'Delete', unnest(regexp_extract_all(body, '(?i)DELETE\\s+FROM\\s+(\\w+)', 1)) FROM s) x""")  # fmt: skip
def sql_operations(s, d):
    return _snippets(s).select("id", F.explode(fn.sql_operations(F.col("body"))).alias("o")).select("id", "o.op", F.col("o.table").alias("tbl"))


def _pattern(p: str) -> str:
    return p.replace("'", "''")


def _text_functions() -> None:
    from ..parsers import patterns as p

    many = {
        "f05_send": p.SEND, "f06_topics": p.TOPICS, "f07_subscribe": p.SUBSCRIBE, "f08_redis_get": p.JAVA_REDIS_GET,
        "f08_redis_set": p.JAVA_REDIS_SET, "f08_redis_delete": p.JAVA_REDIS_DELETE, "f09_path_params": p.BRACE_PARAM, "jv14_path_literal": p.LITERAL,
    }
    for name, pattern in many.items():
        sql = f"WITH {_SNIPPETS} SELECT id, unnest(regexp_extract_all(body, '{_pattern(pattern)}', 1)) AS found FROM s"
        query(name, sql)(lambda s, d, x=pattern: _snippets(s).select("id", F.explode(fn.matches(F.col("body"), x)).alias("found")))


_text_functions()


@query("f10_split_target", f"""WITH {_SNIPPETS} SELECT id, CASE WHEN contains(target, '::') THEN regexp_extract(target, '^(.*)::', 1) END AS cls,
split_part(target, '::', -1) AS method FROM s""")  # fmt: skip
def split_target(s, d):
    return _snippets(s).select("id", fn.split_class(F.col("target")).alias("cls"), fn.split_method(F.col("target")).alias("method"))


@query("f14_endpoint_path", "SELECT page_id, nullif(regexp_extract(url, '^https?://[^/]*(/[^?]*)', 1), '') AS path FROM pages")
def endpoint_path(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.endpoint_path(F.col("url")).alias("path"))


@query("f12_redis_key_matches", """SELECT DISTINCT a.source AS pattern, b.source AS other FROM documents a JOIN documents b ON a.doc_id = b.doc_id
WHERE starts_with(b.source || ':1', rtrim(a.source || ':*', '*'))""")  # fmt: skip
def redis_keys(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("source").distinct()
    hit = fn.redis_key_matches(F.concat("source", F.lit(":*")), F.concat("source", F.lit(":1")))
    return docs.where(hit).select(F.col("source").alias("pattern"), F.col("source").alias("other"))


@query("f15_joined_path", """SELECT DISTINCT source, 'svc/' || source || '/' || lang || '/x' AS path FROM documents WHERE lang IS NOT NULL""")
def joined_path(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL").select("source", "lang").distinct()
    return docs.select("source", fn.joined_path(F.lit("svc/"), F.concat(F.lit("/"), "source"), F.lit(""), F.col("lang"), F.lit("//x")).alias("path"))


@query("f13_http_client", f"WITH {_SNIPPETS} SELECT id, regexp_matches(lower(target), 'httpclient|resttemplate|webclient|http::get|http::post|reqwest|hyper') AS hit, CASE WHEN contains(body, 'RequestMethod.POST') THEN 'POST' ELSE 'GET' END AS method FROM s")
def http_client(s, d):
    return _snippets(s).select("id", fn.is_http_client(F.col("target")).alias("hit"), fn.request_method(F.col("body")).alias("method"))


@query("f16_file_names", """SELECT DISTINCT p_brand AS brand, p_brand AS stem, 'java' AS ext, 'java' AS language, 'src/' || p_brand || '.java' AS path FROM part""")
def file_names(s, d):
    path = F.concat(F.lit("a/src/"), "p_brand", F.lit(".java"))
    parts = s.read.parquet(f"{d}/part.parquet").select("p_brand").distinct()
    return parts.select(F.col("p_brand").alias("brand"), fn.stem(path).alias("stem"), fn.extension(path).alias("ext"), fn.language(path).alias("language"), fn.strip_side(path).alias("path"))


@query("f17_config_keys", "SELECT DISTINCT 'http:GET:/' || source AS h, 'kafka:topic:' || source AS k, 'db:table:' || source AS t, 'redis:key:' || source AS r FROM documents")
def key_names(s, d):
    x = F.col("source")
    docs = s.read.parquet(f"{d}/documents.parquet").select("source").distinct()
    return docs.select(
        fn.config_key("http", F.lit("GET"), F.concat(F.lit("/"), x)).alias("h"), fn.config_key("kafka", x).alias("k"),
        fn.config_key("db", x).alias("t"), fn.config_key("redis", x).alias("r"),
    )


@query("f19_since_epoch", """SELECT event_id, CAST(event_id * 7919 // 86400 AS VARCHAR) || ' days, ' || lpad(CAST(event_id * 7919 // 3600 % 24 AS VARCHAR), 2, '0') || ':'
|| lpad(CAST(event_id * 7919 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id * 7919 % 60 AS VARCHAR), 2, '0') AS shown FROM events""")  # fmt: skip
def since_epoch(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", fn.since_epoch(F.col("event_id") * 7919).alias("shown"))


# -- parsers as table functions

PATCH = "--- a/src/A.java\n+++ b/src/A.java\n@@ -3,2 +3,3 @@ class A\n a\n-b\n+c\n+d\n--- /dev/null\n+++ b/New.rs\n@@ -0,0 +1 @@\n+fn x() {}\n"


@query("p01_patch_hunks", """SELECT * FROM (VALUES ('p1', 'p1/src/A.java', 'Modified', 0, 3, 2, 3, 3), ('p1', 'p1/New.rs', 'Added', 0, 0, 0, 1, 1))
t(project, file_path, change_type, hunk_idx, old_start, old_lines, new_start, new_lines)""")  # fmt: skip
def patch_hunks(s, d):
    return tf.hunks(tf.patches(s.createDataFrame([("x/p1.patch", PATCH)], "path string, content string")))


@query("p02_patch_trailer", "SELECT 'a' || chr(10) || '-- ' || chr(10) AS text")
def patch_trailer(s, d):
    return s.createDataFrame([(patch.without_trailer("a\n-- \n2.1\n"),)], "text string")


JAVA = """package com.acme.shop;
import com.acme.core.UserService;
@RequestMapping("/orders")
public class Orders implements Api {
  private UserService users;
  @GetMapping("/{id}") String get(String id) { users.find(id); return repo("SELECT a FROM orders"); }
}
"""


@query("jv01_java_methods", """SELECT * FROM (VALUES ('com.acme.shop.Orders::get', 'com.acme.core.UserService::find', '/orders/{id}'),
('com.acme.shop.Orders::get', 'repo', '/orders/{id}')) t(fqn, callee, path)""")  # fmt: skip
def java_methods(s, d):
    parsed = tf.parsed(s.createDataFrame([("/w/Orders.java", JAVA)], "path string, content string"))
    rows = fx.exploded(parsed).select("fqn", F.explode("calls").alias("c"), "http")
    return rows.select("fqn", F.col("c.target").alias("callee"), F.concat(F.lit("/"), "http.path").alias("path"))


XML = "<c><user-url>https://h/api/users/{id}?x=1</user-url><topic-name>t1</topic-name><table>users</table><cache>u:*</cache></c>"


@query("c01_config_items", """SELECT * FROM (VALUES ('c.xml', 'http', 'GET', '/api/users/{id}'), ('c.xml', 'kafka', NULL, 't1'), ('c.xml', 'db', NULL, 'users'),
('c.xml', 'redis', NULL, 'u:*'), ('c.yml', 'db', NULL, 'orders'), ('c.yml', 'kafka', NULL, 'a'), ('c.yml', 'kafka', NULL, 'b')) t(file_path, kind, http_method, value)""")  # fmt: skip
def config_items(s, d):
    rows = [("c.xml", XML), ("c.yml", "x:\n  topics: [a, b, a]\n  tableName: orders\n")]
    return tf.configured(s.createDataFrame(rows, "path string, content string"))[0]


RUST = """use std::{io, fs};
mod user {
    pub fn create_user(id: u32) -> bool { println!("x {}", hidden(id)); check(id); sqlx::query("INSERT INTO users VALUES (1)") }
}
fn routes() { Router::new().route("/users/:id", get(show)); redis.get("user:*"); producer.send("user-events"); }
"""


@query("rs01_rust_calls", """SELECT * FROM (VALUES ('user::create_user', 3, 'println!'), ('user::create_user', 3, 'check'),
('user::create_user', 3, 'sqlx::query'), ('routes', 5, 'Router::new'), ('routes', 5, 'Router::new().route'), ('routes', 5, 'get'),
('routes', 5, 'redis.get'), ('routes', 5, 'producer.send')) t(fqn, line, callee)""")  # fmt: skip
def rust_calls(s, d):
    parsed = tf.parsed(s.createDataFrame([("/w/a.rs", RUST)], "path string, content string"))
    return fx.exploded(parsed).select("fqn", F.explode("calls").alias("c")).select("fqn", "c.line", F.col("c.target").alias("callee"))


@query("rs05_rust_operations", """SELECT * FROM (VALUES ('user::create_user', 'db', 'Insert', 'users'), ('routes', 'redis', 'Get', 'user:*'),
('routes', 'kafka', 'Produce', 'user-events'), ('routes', 'http', 'GET', '/users/:id')) t(fqn, kind, op, name)""")  # fmt: skip
def rust_operations(s, d):
    parsed = tf.parsed(s.createDataFrame([("/w/a.rs", RUST)], "path string, content string"))
    f = fx.from_parsed(parsed)
    part = lambda df, kind, op, name: df.select("fqn", F.lit(kind).alias("kind"), F.col(op).alias("op"), F.col(name).alias("name"))
    return (
        part(f.db, "db", "op", "table").unionByName(part(f.redis, "redis", "op", "key_pattern"))
        .unionByName(part(f.kafka, "kafka", "op", "topic")).unionByName(part(f.http, "http", "method", "path"))
    )


@query("rs10_imports", """SELECT * FROM (VALUES ('/w/a.rs', 'std', 'io,fs'), ('/w/Orders.java', 'com.acme.core.UserService', '')) t(file_path, module, items)""")
def imports(s, d):
    parsed = tf.parsed(s.createDataFrame([("/w/a.rs", RUST), ("/w/Orders.java", JAVA)], "path string, content string"))
    each = parsed.select("file_path", F.explode("imports").alias("i"))
    return each.select("file_path", "i.module", F.array_join("i.items", ",").alias("items"))


@query("jv02_java_classes", """SELECT 'com.acme.shop.Orders' AS name, false AS is_interface, 'com.acme.shop.Api' AS iface, 3 AS line_start, 7 AS line_end""")
def java_classes(s, d):
    parsed = tf.parsed(s.createDataFrame([("/w/Orders.java", JAVA)], "path string, content string"))
    c = parsed.select(F.explode("classes").alias("c"))
    return c.select("c.name", "c.is_interface", F.array_join("c.implements", ",").alias("iface"), "c.line_start", "c.line_end")


@query("p01_patch_lines", """SELECT * FROM (VALUES ('src/A.java', 0, 0, 'Context', 'a'), ('src/A.java', 0, 1, 'Removed', 'b'), ('src/A.java', 0, 2, 'Added', 'c'),
('src/A.java', 0, 3, 'Added', 'd'), ('New.rs', 0, 0, 'Added', 'fn x() {}')) t(file_path, hunk_idx, pos, line_type, content)""")  # fmt: skip
def patch_lines(s, d):
    return tf.hunk_lines(tf.patches(s.createDataFrame([("x/p1.patch", PATCH)], "path string, content string"), prefix=False))


@query("s03_language", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'java' WHEN page_id % 3 = 1 THEN 'rust' END AS language FROM pages""")
def languages(s, d):
    ext = F.element_at(F.array(F.lit("/x.java"), F.lit("/y.z.rs"), F.lit("/java")), (F.col("page_id") % 3 + 1).cast("int"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.language(F.concat(F.col("url"), ext)).alias("language"))


@query("f09_colon_params", "SELECT page_id, string_agg(p, ',' ORDER BY p) AS params FROM (SELECT page_id, unnest(regexp_extract_all(url || '/:id/:item', ':(\\w+)', 1)) AS p FROM pages) x GROUP BY page_id")
def colon_params(s, d):
    from ..parsers import patterns as p

    each = s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.matches(F.concat("url", F.lit("/:id/:item")), p.COLON_PARAM).alias("p"))
    return each.select("page_id", F.array_join(F.array_sort("p"), ",").alias("params"))


@query("f11_path_matches", "SELECT page_id, contains(lower(url), lower(split_part(url, '/', 4))) AND contains(lower(url), 'example') AS hit FROM pages")
def path_matches(s, d):
    pattern = F.concat_ws("/", F.lit(""), F.upper(F.split_part("url", F.lit("/"), F.lit(4))), F.lit("{id}"), F.lit("EXAMPLE"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", fn.path_matches(pattern, F.col("url")).alias("hit"))


@query("f20_overlaps", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_linenumber <= l_quantity AND l_linenumber + 3 >= l_quantity - 5 GROUP BY 1")
def overlap_counts(s, d):
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    hit = fn.overlaps(line, line + 3, q - 5, q)
    return s.read.parquet(f"{d}/lineitem.parquet").where(hit).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("f21_same_major", "SELECT event_id, split_part(CAST(value AS STRING), '.', 1) = split_part(CAST(floor(value) AS STRING), '.', 1) AS same FROM events")
def same_major(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", fn.same_major(F.col("value").cast("string"), F.floor("value").cast("string")).alias("same"))


@query("g02_first_nodes", """SELECT DISTINCT 'kafka:' || event_type AS id, 'kafka_topic' AS kind, 'Kafka: ' || event_type AS label FROM events
UNION SELECT DISTINCT 'redis:' || source, 'redis_prefix', 'Redis: ' || source FROM documents
UNION SELECT DISTINCT 'db:' || o_orderpriority, 'database_table', 'Table: ' || o_orderpriority FROM orders
UNION SELECT 'http:GET:/' || CAST(page_id AS STRING), 'http_endpoint', 'GET /' || CAST(page_id AS STRING) FROM pages""")  # fmt: skip
def first_nodes(s, d):
    ids = _sql(s, d, """SELECT 'kafka:' || event_type AS id FROM events UNION ALL SELECT 'redis:' || source FROM documents
        UNION ALL SELECT 'db:' || o_orderpriority FROM orders UNION ALL SELECT 'http:GET:/' || CAST(page_id AS STRING) FROM pages""",
        "events", "documents", "orders", "pages")
    return graph.nodes_of(ids).select("id", "kind", "label")


@query("g08_dot_edges", f"""{_CALL_EDGES} SELECT '    "' || src || '" -> "' || dst || '" [ label="method_call" dir="' || lower(direction) || '" ]' AS line FROM e""")
def dot_edges(s, d):
    return graph.dot_edges(_traced(s, d)[1]).select("line")


@query("g07_json_nodes", f"""{_CALL_EDGES} SELECT id, '{{"id":"' || id || '","type":{{"kind":"method","qualified_name":"' || substr(id, 8) || '"}},"label":"' || substr(id, 8) || '","properties":{{}}}}' AS json FROM n""")
def json_nodes(s, d):
    return graph.json_nodes(_traced(s, d)[0])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of everything impacted across services by customers whose balance is largest."""
    text = "SELECT 'c' || CAST(c_custkey AS STRING) || '::order' AS fqn FROM customer WHERE c_acctbal > 9900"
    seeds_ = _sql(spark, sf_dir, text, "customer")
    return trace.trace(spark, _service_facts(spark, sf_dir), seeds_, trace.TraceConfig(max_depth=2))[1]
