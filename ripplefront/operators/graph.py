"""The impact graph: nodes, edges, cycles and what is written of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut, kept_by

#: Kinds, labels and shapes by the prefix of a node's id.
KINDS = {"method": "method", "http": "http_endpoint", "kafka": "kafka_topic", "db": "database_table", "redis": "redis_prefix"}
SHAPES = {"method": "box", "http": "ellipse", "kafka": "diamond", "db": "cylinder", "redis": "hexagon"}
SHORT = {"method": "method", "http": "http", "kafka": "kafka", "db": "database", "redis": "redis"}
PREFIXES = {"method": "", "http": "", "kafka": "Kafka: ", "db": "Table: ", "redis": "Redis: "}
JSON_TYPES = {
    "MethodCall": "method_call", "HttpCall": "http_call", "KafkaProduceConsume": "kafka_produce_consume",
    "DatabaseReadWrite": "database_read_write", "RedisReadWrite": "redis_read_write",
}
DOT_TYPES = {
    "MethodCall": "method_call", "HttpCall": "http_call", "KafkaProduceConsume": "kafka",
    "DatabaseReadWrite": "database", "RedisReadWrite": "redis",
}


def chosen(column: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[column]


def node_id(kind: str, *parts: Column) -> Column:
    """method:F, http:M:P, kafka:T, db:T or redis:K."""
    return F.concat_ws(":", F.lit(kind), *parts)


def nodes_of(ids: DataFrame) -> DataFrame:
    """id, kind, label, properties of a table of ids; the first of equal ids counts, as one."""
    prefix = F.substring_index("id", ":", 1)
    name = F.expr("substring(id, length(substring_index(id, ':', 1)) + 2)")
    label = F.when(prefix == "http", F.regexp_replace(name, r"^([^:]*):", "$1 ")).otherwise(F.concat(chosen(prefix, PREFIXES), name))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return ids.select("id").distinct().select("id", chosen(prefix, KINDS).alias("kind"), label.alias("label"), empty.alias("properties"))


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def get_node(nodes: DataFrame, node: str) -> DataFrame:
    """The node of an id: one row or none."""
    return nodes.where(F.col("id") == F.lit(node))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return row_counts({"node_count": nodes, "edge_count": edges})


def cycles(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, component): strongly connected components of two nodes or more, by their least id.

    Nodes without a way in or out are in no cycle and are trimmed. A node with one way in and
    one way out is in a cycle just if the chain it lies on is: chains are found by pointer
    jumping, as are rings of nothing but such nodes, and each chain becomes one edge. So
    paths, trees and rings of any length go in a logarithmic number of rounds. In what is
    left each node takes the least label that reaches it, and the nodes that reach the
    label's own node back, within that label, are its component and leave. Reaching
    ``max_rounds`` is an error, never a smaller result.
    """
    every = edges.where("src != dst").select("src", "dst").distinct()
    left = cut(every)
    names = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = names.select("id", F.col("id").alias("component")).limit(0)
    chains: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        before = left.count()
        left = _trimmed(left)
        left, chain, rings = _compressed(left, max_rounds)
        chains.append(chain)
        found = found.unionByName(rings)
        if left.count() < before:
            continue
        part, left = _parted(left, max_rounds)
        found = found.unionByName(part)
    else:
        raise RuntimeError(f"cycles did not settle in {max_rounds} rounds")
    # nodes on a chain are in the component of its ends, if that is one; the last chains come first
    for chain in reversed(chains):
        ends = chain
        for end in ("first", "last"):
            of = found.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
            ends = ends.join(of, end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
        inside = ends.where("first_component = last_component").select("id", F.col("first_component").alias("component"))
        hubs = inside.select(F.col("component").alias("id"), "component")  # a chain back to its own start
        found = cut(found.unionByName(inside).unionByName(hubs).distinct())
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    return found.join(many, "component").select("id", F.col("least").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges from nodes nothing leads to, and to nodes that lead nowhere."""
    kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return cut(kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def _compressed(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chain, rings): each chain as one edge; (id, first, last) of its nodes; whole rings found."""
    one_in = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("before")).where("n = 1")
    one_out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("after")).where("n = 1")
    links = cut(one_in.select("id", "before").join(one_out.select("id", "after"), "id"))
    jumps, ahead = links.select("id", "before", "after", F.col("id").alias("least")), None
    for _ in range(rounds):
        nxt = jumps.select(F.col("id").alias("after"), F.col("after").alias("after_2"), F.col("least").alias("least_2"))
        prev = jumps.select(F.col("id").alias("before"), F.col("before").alias("before_2"))
        far = jumps.join(nxt, "after", "left").join(prev, "before", "left")
        least = F.least("least", "least_2")  # of what the jump passes over
        jumps = cut(far.select(
            "id", F.coalesce("before_2", "before").alias("before"), F.coalesce("after_2", "after").alias("after"), least.alias("least"),
            F.col("after_2").isNotNull().alias("on"), F.col("before_2").isNotNull().alias("back"), (least < F.col("least")).alias("lower"),
        ))
        on = F.col("on") | F.col("back")
        # paths get done from their ends, each round some; rings never, but their least name settles
        state = tuple(jumps.agg(F.count(F.when(on, 1)), F.count(F.when(on & F.col("lower"), 1))).first())
        jumps = jumps.select("id", "before", "after", "least", on.alias("on"))
        if state[0] == 0 or state == (ahead, 0):
            break
        ahead = state[0]
    else:
        raise RuntimeError(f"chains did not settle in {rounds} rounds")
    rings = jumps.where("on").select("id", F.col("least").alias("component"))
    chain = jumps.where("NOT on").select("id", F.col("before").alias("first"), F.col("after").alias("last"))
    ids = links.select("id")
    rest = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    ends = chain.where("first != last").select(F.col("first").alias("src"), F.col("last").alias("dst"))
    return cut(rest.select("src", "dst").unionByName(ends).distinct()), cut(chain), cut(rings)


def _parted(left: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(found, edges): the components of the least labels, and the edges between nodes of no such one."""
    label = _spread(left, rounds)
    inside = left.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(
        label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst"
    )
    inside = cut(inside.where("a = b").select("src", "dst", F.col("a").alias("label")))
    found = _back(inside, label, rounds)
    gone = found.select("id")
    rest = left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return found, cut(rest.select("src", "dst"))


def _spread(edges: DataFrame, rounds: int) -> DataFrame:
    """The least id that reaches each node."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    label = cut(ids.select("id", F.col("id").alias("label")))
    edges = kept_by(edges, "src")
    changed = label
    for _ in range(rounds):
        if changed.isEmpty():
            break
        sent = edges.join(changed, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label")
        least = sent.groupBy("id").agg(F.min("label").alias("new"))
        all_ = cut(label.join(least, "id", "left").select("id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("lower")))
        label, changed = all_.select("id", "label"), all_.where("lower").select("id", "label")
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    edges.unpersist()
    return label


def _back(inside: DataFrame, label: DataFrame, rounds: int) -> DataFrame:
    """The nodes that reach their own label's node: (id, component)."""
    found = cut(label.where("id = label").select("id", F.col("label").alias("component")))
    frontier = found
    inside = kept_by(inside, "dst", "label")
    for _ in range(rounds):
        step = inside.join(frontier, (F.col("dst") == F.col("id")) & (F.col("label") == F.col("component")))
        frontier = cut(step.select(F.col("src").alias("id"), "component").distinct().join(found, ["id", "component"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    else:
        raise RuntimeError(f"the way back did not end in {rounds} rounds")
    inside.unpersist()
    return cut(found)


# -- sinks


def json_nodes(nodes: DataFrame) -> DataFrame:
    """One JSON object for each node, in its fixed form."""
    prefix, name = F.substring_index("id", ":", 1), F.expr("substring(id, length(substring_index(id, ':', 1)) + 2)")
    kind = (
        F.when(prefix == "method", F.to_json(F.struct(F.lit("method").alias("kind"), name.alias("qualified_name"))))
        .when(prefix == "http", F.to_json(F.struct(F.lit("http_endpoint").alias("kind"), F.substring_index(name, ":", 1).alias("method"), F.regexp_replace(name, "^[^:]*:", "").alias("path"))))
        .when(prefix == "redis", F.to_json(F.struct(F.lit("redis_prefix").alias("kind"), name.alias("prefix"))))
        .otherwise(F.to_json(F.struct(chosen(prefix, KINDS).alias("kind"), name.alias("name"))))
    )
    whole = F.to_json(F.struct("id", F.from_json(kind, "map<string,string>").alias("type"), "label", "properties"))
    return nodes.select("id", whole.alias("json"))


def json_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), chosen(F.col("edge_type"), JSON_TYPES).alias("type"), F.lower("direction").alias("direction"))).alias("json")
    )


def to_json(nodes: DataFrame, edges: DataFrame) -> str:
    """The whole graph as one text, for graphs a person reads; write json_nodes for others."""
    import json

    n = [json.loads(r["json"]) for r in json_nodes(nodes).orderBy("id").toLocalIterator()]
    e = [json.loads(r["json"]) for r in json_edges(edges).orderBy("json").toLocalIterator()]
    return json.dumps({"nodes": n, "edges": e, "node_count": len(n), "edge_count": len(e)}, indent=2, ensure_ascii=False)


def dot_nodes(nodes: DataFrame) -> DataFrame:
    """(id, line): a DOT statement for each node, named by its quoted id."""
    prefix = F.substring_index("id", ":", 1)
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("    "), q(F.col("id")), F.lit(" [ label="), q(F.col("label")), F.lit(' shape="'), chosen(prefix, SHAPES), F.lit('" type="'), chosen(prefix, SHORT), F.lit('" ]'))
    return nodes.select("id", line.alias("line"))


def dot_edges(edges: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("    "), q(F.col("src")), F.lit(" -> "), q(F.col("dst")), F.lit(' [ label="'), chosen(F.col("edge_type"), DOT_TYPES), F.lit('" dir="'), F.lower("direction"), F.lit('" ]'))
    return edges.select("src", "dst", line.alias("line"))


def write(nodes: DataFrame, edges: DataFrame, path: str, form: str = "json") -> None:
    """The graph as text files below ``path``, one line for each node and edge, written by the tasks.

    For graphs that no driver holds: ``nodes`` and ``edges`` are folders of JSON lines or of
    DOT statements (put ``digraph {`` and ``}`` around them).
    """
    lines = {"json": (json_nodes(nodes).select("json"), json_edges(edges)), "dot": (dot_nodes(nodes).select("line"), dot_edges(edges).select("line"))}
    if form not in lines:
        raise ValueError(f"no such form: {form}")
    for name, df in zip(("nodes", "edges"), lines[form], strict=True):
        df.write.mode("overwrite").text(f"{path}/{name}")


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    n = [r["line"] for r in dot_nodes(nodes).orderBy("id").toLocalIterator()]
    e = [r["line"] for r in dot_edges(edges).orderBy("line").toLocalIterator()]
    return "\n".join(["digraph {", *n, *e, "}"]) + "\n"


def to_mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    number, lines = {}, ["graph LR"]
    for r in nodes.orderBy("id").toLocalIterator():
        number[r["id"]] = f"n{len(number)}"
        lines.append(f'    {number[r["id"]]}["{r["label"].replace(chr(34), "#quot;")}"]')
    for r in edges.orderBy("src", "dst", "edge_type", "direction").toLocalIterator():
        lines.append(f"    {number[r['src']]} -->|{DOT_TYPES[r['edge_type']]}| {number[r['dst']]}")
    return "\n".join(lines) + "\n"
