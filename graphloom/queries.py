"""Registered queries: the library's operators on the driver's tables, each with its SQL.

Edge tables: T, event type to next event type of a user; H, the forest region, nation,
supplier; B, customer to supplier; P, part to supplier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import names
from .operators import evaluate, graph, partition, resolve, sequence
from .plans import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(s: SparkSession, d: str) -> DataFrame:
    """(user_id, pos, caller, callee): each user's events paired with the next one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("user_id", F.row_number().over(w).alias("pos"), F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee"))


def edges_t(s: SparkSession, d: str) -> DataFrame:
    return _steps(s, d).where("callee is not null").select("caller", "callee").distinct()


def edges_h(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("caller"), F.concat(F.lit("N"), "n_nationkey").alias("callee"))
    b = table(s, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("caller"), F.concat(F.lit("S"), "s_suppkey").alias("callee"))
    return a.unionByName(b)


def edges_b(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "orders").select("o_orderkey", "o_custkey").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct(), "o_orderkey").select("o_custkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("C"), "o_custkey").alias("caller"), F.concat(F.lit("S"), "l_suppkey").alias("callee"))


def edges_p(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("P"), "l_partkey").alias("caller"), F.concat(F.lit("S"), "l_suppkey").alias("callee"))


_STEPS = "steps AS (SELECT user_id, row_number() OVER w AS pos, event_type AS caller, lead(event_type) OVER w AS callee FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_T = _STEPS + ", t AS (SELECT DISTINCT caller, callee FROM steps WHERE callee IS NOT NULL)"
_H = "h AS (SELECT 'R' || n_regionkey AS caller, 'N' || n_nationkey AS callee FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"
_B = "b AS (SELECT DISTINCT 'C' || o_custkey AS caller, 'S' || l_suppkey AS callee FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_P = "p AS (SELECT DISTINCT 'P' || l_partkey AS caller, 'S' || l_suppkey AS callee FROM lineitem)"


# --- edges and degrees ---------------------------------------------------------------------------------------------


@query(f"WITH {_STEPS} SELECT caller, callee, count(*) AS n FROM steps WHERE callee IS NOT NULL GROUP BY ALL")
def call_edges(s, d):
    return _steps(s, d).where("callee is not null").groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query(f"WITH {_B}, n AS (SELECT caller AS node FROM b UNION SELECT callee FROM b) SELECT node, count(DISTINCT caller) AS fan_in FROM n LEFT JOIN b ON callee = node GROUP BY node")
def fan_in(s, d):
    return graph.fan_in(edges_b(s, d))


@query(f"WITH {_B}, n AS (SELECT caller AS node FROM b UNION SELECT callee FROM b) SELECT node, count(DISTINCT callee) AS fan_out FROM n LEFT JOIN b ON caller = node GROUP BY node")
def fan_out(s, d):
    return graph.fan_out(edges_b(s, d))


@query(f"WITH {_B}, n AS (SELECT caller AS node FROM b UNION SELECT callee FROM b), f AS (SELECT node, count(DISTINCT caller) AS fan_in FROM n LEFT JOIN b ON callee = node GROUP BY node) SELECT fan_in, count(*) AS nodes FROM f GROUP BY fan_in")
def fan_distribution(s, d):
    return graph.fan_in(edges_b(s, d)).groupBy("fan_in").agg(F.count("*").alias("nodes"))


@query(f"WITH {_B} SELECT callee AS node, count(DISTINCT caller) AS fan_in FROM b GROUP BY callee HAVING count(DISTINCT caller) >= 100")
def high_fan_in(s, d):
    return graph.high_fan_in(edges_b(s, d), 100)


@query(f"WITH {_P} SELECT caller AS node, count(DISTINCT callee) AS fan_out FROM p GROUP BY caller HAVING count(DISTINCT callee) >= 5")
def high_fan_out(s, d):
    return graph.high_fan_out(edges_p(s, d), 5)


@query(f"WITH {_H} SELECT 'out' AS side, caller, callee FROM h WHERE caller = 'N3' UNION ALL SELECT 'in', caller, callee FROM h WHERE callee = 'N3'")
def outgoing_incoming(s, d):
    h = edges_h(s, d)
    return graph.outgoing(h, "N3").select(F.lit("out").alias("side"), "caller", "callee").unionByName(graph.incoming(h, "N3").select(F.lit("in").alias("side"), "caller", "callee"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def ordered_distinct_calls(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id")
    return graph.first_of(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, count(*) AS n_calls, count(DISTINCT event_type) AS n_distinct FROM events GROUP BY user_id")
def call_counts(s, d):
    per = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_distinct"))


# --- reach, components, cycles -------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_H}, r AS (SELECT 'R0' AS node, 0 AS depth UNION SELECT callee, depth + 1 FROM r JOIN h ON caller = node WHERE depth < 1) SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node")
def reachable_depth1(s, d):
    return graph.reachable(edges_h(s, d), s.createDataFrame([("R0",)], "node string"), 1)


@query(f"WITH RECURSIVE {_H}, r AS (SELECT 'R0' AS node, 0 AS depth UNION SELECT callee, depth + 1 FROM r JOIN h ON caller = node WHERE depth < 2) SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node")
def reachable_depth2(s, d):
    return graph.reachable(edges_h(s, d), s.createDataFrame([("R0",)], "node string"), 2)


@query(f"WITH RECURSIVE {_H}, r AS (SELECT 'R' || r_regionkey AS node FROM region UNION SELECT callee FROM r JOIN h ON caller = node) SELECT node FROM r")
def reachable_all(s, d):
    roots = table(s, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return graph.reachable(edges_h(s, d), roots).select("node")


@query(f"WITH RECURSIVE {_H}, r AS (SELECT 'R0' AS node, 0 AS depth UNION SELECT callee, depth + 1 FROM r JOIN h ON caller = node WHERE depth < 1) SELECT DISTINCT caller, callee FROM h JOIN r ON caller = node WHERE depth < 1")
def reachable_subgraph(s, d):
    h = edges_h(s, d)
    return graph.reachable_edges(h, graph.reachable(h, s.createDataFrame([("R0",)], "node string"), 1), 1)


_CYCLES = f"""WITH RECURSIVE {_T}, p AS (SELECT caller AS first, callee AS last, [caller] AS path FROM t WHERE callee >= caller
UNION ALL SELECT p.first, t.callee, list_append(p.path, p.last) FROM p JOIN t ON t.caller = p.last WHERE p.last <> p.first AND (t.callee = p.first OR (t.callee > p.first AND NOT list_contains(p.path, t.callee) AND t.callee <> p.last)))
SELECT array_to_string(list_append(path, first), '>') AS cycle FROM p WHERE last = first"""


@query(_CYCLES)
def elementary_cycles(s, d):
    return graph.elementary_cycles(edges_t(s, d)).select(F.array_join("path", ">").alias("cycle"))


_TP = f"{_T}, e AS (SELECT caller, callee FROM t UNION ALL SELECT caller, 'leaf_' || caller FROM t GROUP BY caller)"
_SCC = f"WITH RECURSIVE {_TP}, n AS (SELECT caller AS node FROM e UNION SELECT callee FROM e), c AS (SELECT caller AS a, callee AS b FROM e UNION SELECT c.a, e.callee FROM c JOIN e ON e.caller = c.b), m AS (SELECT x.a, x.b FROM c x JOIN c y ON x.a = y.b AND x.b = y.a)"


def _pendant(s, d):
    t = edges_t(s, d)
    return t.unionByName(t.select("caller", F.concat(F.lit("leaf_"), "caller").alias("callee")).distinct())


@query(_SCC + " SELECT node, coalesce(least(node, min(b)), node) AS component FROM n LEFT JOIN m ON a = node GROUP BY node")
def scc(s, d):
    return graph.strong_components(_pendant(s, d))


@query(_SCC + " SELECT DISTINCT e.caller, e.callee FROM e WHERE e.caller = e.callee OR EXISTS (SELECT 1 FROM m WHERE a = e.caller AND b = e.callee)")
def cycle_edges(s, d):
    e = _pendant(s, d)
    return graph.cycle_edges(e, graph.strong_components(e))


@query(_SCC + " SELECT DISTINCT node FROM n JOIN m ON a = node")
def cycle_nodes(s, d):
    e = _pendant(s, d)
    return graph.cyclic_nodes(e, graph.strong_components(e))


@query(f"WITH RECURSIVE {_H}, u AS (SELECT caller AS a, callee AS b FROM h UNION SELECT callee, caller FROM h), c AS (SELECT a AS node, a AS r FROM u UNION SELECT u.b, c.r FROM c JOIN u ON u.a = c.node) SELECT node, min(r) AS component FROM c GROUP BY node")
def weak_components(s, d):
    return graph.weak_components(edges_h(s, d))


# --- partition -----------------------------------------------------------------------------------------------------

# In a forest a nation starts a series iff it has two suppliers or more and its region two nations or more.
_SERIES = f"""{_H}, k AS (SELECT n.n_nationkey AS n, n.n_regionkey AS r, (SELECT count(*) FROM supplier WHERE s_nationkey = n.n_nationkey) AS s, (SELECT count(*) FROM nation x WHERE x.n_regionkey = n.n_regionkey) AS m FROM nation n),
q AS (SELECT *, s >= 2 AND m >= 2 AS own FROM k),
series AS (SELECT 'N' || n AS node, CASE WHEN own THEN 'N' || n ELSE 'R' || r END AS series_root, CASE WHEN own THEN 1 ELSE 0 END AS depth, CASE WHEN own THEN 'R' || r END AS parent_root FROM q
UNION ALL SELECT 'S' || s_suppkey, CASE WHEN own THEN 'N' || n ELSE 'R' || r END, CASE WHEN own THEN 1 ELSE 0 END, CASE WHEN own THEN 'R' || r END FROM supplier JOIN q ON n = s_nationkey
UNION ALL SELECT DISTINCT 'R' || r, 'R' || r, 0, NULL FROM q)"""


@query(f"WITH {_SERIES} SELECT node, series_root, CAST(depth AS INT) AS depth, parent_root FROM series")
def partition_series(s, d):
    return partition.partition(edges_h(s, d))[0].select("node", "series_root", "depth", "parent_root")


@query(
    f"""WITH {_SERIES}, z AS (SELECT series_root, count(*) AS n, max(depth) AS dp FROM series GROUP BY 1), x AS (SELECT count(*) AS e, count(*) FILTER (WHERE a.series_root <> b.series_root) AS c FROM h JOIN series a ON a.node = caller JOIN series b ON b.node = callee)
SELECT unnest(['shared_node_count','series_count','max_nodes_per_series','average_nodes_per_series','max_depth','regular_edge_count','cross_series_edge_count','cross_series_ratio','total_node_count','shared_ratio']) AS metric,
unnest([0::DOUBLE, (SELECT count(*) FROM z)::DOUBLE, (SELECT max(n) FROM z)::DOUBLE, (SELECT avg(n) FROM z)::DOUBLE, (SELECT max(dp) FROM z)::DOUBLE, e::DOUBLE, c::DOUBLE, c::DOUBLE / e, (SELECT sum(n) FROM z)::DOUBLE, 0::DOUBLE]) AS value FROM x"""
)
def partition_stats(s, d):
    h = edges_h(s, d)
    series, hubs = partition.partition(h)
    return partition.statistics(h, None, series, hubs)


@query(f"WITH {_P} SELECT callee AS node FROM p GROUP BY callee HAVING count(DISTINCT caller) >= 520")
def shared_nodes(s, d):
    return partition.shared_nodes(edges_p(s, d), 520)


@query(f"WITH {_P}, x AS (SELECT callee AS node FROM p GROUP BY callee HAVING count(DISTINCT caller) >= 520) SELECT caller, callee FROM p WHERE caller NOT IN (SELECT node FROM x) AND callee NOT IN (SELECT node FROM x)")
def regular_edges(s, d):
    p = edges_p(s, d)
    return partition.regular_edges(p, partition.shared_nodes(p, 520))


@query("SELECT 'C' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def isolated_nodes(s, d):
    return table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.concat(F.lit("C"), "c_custkey").alias("node"))


# --- resolution ----------------------------------------------------------------------------------------------------


@query(
    """WITH k AS (SELECT DISTINCT p_brand || '.' || replace(p_name, '.', '') AS name FROM part), u AS (SELECT split_part(name, '.', -1) AS simple, min(name) AS target FROM k GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT DISTINCT p_brand AS parent, unnest([replace(p_name, '.', ''), 'self.' || replace(p_name, '.', ''), p_brand || '.' || replace(p_name, '.', ''), 'other.thing']) AS raw FROM part)
SELECT parent, raw, coalesce(k1.name, k2.name, CASE WHEN NOT contains(raw, '.') THEN u.target END, raw) AS target FROM c LEFT JOIN k k1 ON k1.name = raw LEFT JOIN k k2 ON starts_with(raw, 'self.') AND k2.name = parent || '.' || substr(raw, 6) LEFT JOIN u ON u.simple = raw"""
)
def resolve_exact_simple_unique(s, d):
    p = table(s, d, "part").select("p_brand", F.replace("p_name", F.lit("."), F.lit("")).alias("n"))
    known = p.select(F.concat_ws(".", F.col("p_brand"), F.col("n")).alias("name"))
    calls = p.select(F.col("p_brand").alias("parent"), F.explode(F.array("n", F.concat(F.lit("self."), "n"), F.concat_ws(".", "p_brand", "n"), F.lit("other.thing"))).alias("raw")).distinct()
    return resolve.resolve_calls(calls, known)


@query(
    """WITH k AS (SELECT DISTINCT 'com.example' AS name UNION SELECT DISTINCT array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.')), '.') FROM pages WHERE page_id % 3 = 0 UNION SELECT 'net'),
r AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.')), '.') AS ref FROM pages)
SELECT page_id, ref, (SELECT arg_max(name, length(name)) FROM k WHERE ref = name OR starts_with(ref, name || '.')) AS target FROM r"""
)
def resolve_longest_prefix(s, d):
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), r"\.")), ".")
    refs = table(s, d, "pages").select("page_id", host.alias("ref"))
    known = refs.where("page_id % 3 = 0").select(F.col("ref").alias("name")).unionByName(s.createDataFrame([("com.example",), ("net",)], "name string")).distinct()
    return resolve.longest_prefix(refs, known).select("page_id", "ref", "target")


@query(
    """WITH u AS (SELECT n_nationkey, lower(r_name) || '.' || lower(n_name) AS module, n_nationkey % 2 = 0 AS is_package FROM nation JOIN region ON r_regionkey = n_regionkey),
r AS (SELECT *, unnest(['.a', '..b.c', '...d', '.']) AS ref FROM u), x AS (SELECT *, length(ref) - length(ltrim(ref, '.')) AS lvl, ltrim(ref, '.') AS tail FROM r),
y AS (SELECT *, string_split(module, '.') AS parts, CASE WHEN is_package THEN 0 ELSE 1 END + lvl - 1 AS up FROM x)
SELECT module, ref, array_to_string(list_concat(parts[1:greatest(len(parts) - up, 0)], list_filter(string_split(tail, '.'), lambda z: z <> '')), '.') AS full_name FROM y"""
)
def relative_import(s, d):
    u = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", F.lower("r_name"), F.lower("n_name")).alias("module"), (F.col("n_nationkey") % 2 == 0).alias("is_package"))
    return u.select("*", F.explode(F.array(*map(F.lit, (".a", "..b.c", "...d", ".")))).alias("ref")).select("module", "ref", names.resolve_relative("module", "is_package", "ref").alias("full_name"))


@query(
    f"""WITH {_H}, e AS (SELECT caller, callee, 'inheritance' AS label FROM h UNION ALL SELECT caller, callee, 'uses' FROM h WHERE starts_with(caller, 'R')), f AS (SELECT callee, count(DISTINCT caller) AS fan_in, count(*) AS edge_rows FROM e GROUP BY 1)
SELECT fan_in, edge_rows, count(*) AS nodes FROM f GROUP BY ALL"""
)
def class_relations(s, d):
    h = edges_h(s, d)
    e = h.withColumn("label", F.lit("inheritance")).unionByName(h.where("caller like 'R%'").withColumn("label", F.lit("uses")))
    rows = e.groupBy("callee").agg(F.count("*").alias("edge_rows"))
    degree = graph.high_fan_in(e, 1).withColumnRenamed("node", "callee")
    return rows.join(degree, "callee").groupBy("fan_in", "edge_rows").agg(F.count("*").alias("nodes"))


@query(
    """SELECT DISTINCT cr.r_name AS caller, sr.r_name AS callee FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey WHERE cr.r_name <> sr.r_name"""
)
def component_rollup(s, d):
    place = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    a = table(s, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("C"), "c_custkey").alias("caller"), F.col("r_name").alias("a"))
    b = table(s, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("callee"), F.col("r_name").alias("b"))
    return edges_b(s, d).join(a, "caller").join(b, "callee").where("a != b").select(F.col("a").alias("caller"), F.col("b").alias("callee")).distinct()


@query(
    """WITH o AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE r_name END AS scope, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT 'ASIA', 'SHARED' UNION SELECT 'AFRICA', 'SHARED'),
r AS (SELECT DISTINCT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE r_name END AS scope, unnest([n_name, 'SHARED', 'NOWHERE']) AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT *, coalesce(scope, '<module>') || ':' || name AS key FROM o), u AS (SELECT name, min(key) AS key FROM k GROUP BY name HAVING count(*) = 1)
SELECT s_nationkey, r.scope, r.name, coalesce(k.key, u.key) AS target FROM r LEFT JOIN k ON k.scope IS NOT DISTINCT FROM r.scope AND k.name = r.name LEFT JOIN u ON u.name = r.name WHERE coalesce(k.key, u.key) IS NOT NULL"""
)
def object_refs(s, d):
    place = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    objects = place.select(F.when(F.col("n_nationkey") % 3 != 0, F.col("r_name")).alias("scope"), F.col("n_name").alias("name")).unionByName(s.createDataFrame([("ASIA", "SHARED"), ("AFRICA", "SHARED")], "scope string, name string"))
    refs = table(s, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_nationkey", F.when(F.col("s_suppkey") % 2 != 0, F.col("r_name")).alias("scope"), F.explode(F.array("n_name", F.lit("SHARED"), F.lit("NOWHERE"))).alias("name")).distinct()
    return resolve.resolve_objects(refs, objects).select("s_nationkey", "scope", "name", "target")


@query("WITH known AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages WHERE page_id % 2 = 0) SELECT DISTINCT 'external:' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS node FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/]+)', 1) NOT IN (SELECT host FROM known)")
def external_nodes(s, d):
    hosts = table(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    known = hosts.where("page_id % 2 = 0").select("host").distinct()
    return hosts.join(known, "host", "left_anti").select(F.concat(F.lit("external:"), "host").alias("node")).distinct()


# --- states, timing, messages --------------------------------------------------------------------------------------

_STATES = "s AS (SELECT o_custkey, o_orderstatus AS target, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS source FROM orders), tr AS (SELECT source, target, count(*) AS n FROM s WHERE source IS NOT NULL AND source <> target GROUP BY ALL)"


def _transitions(s, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select(F.lag("o_orderstatus").over(w).alias("source"), F.col("o_orderstatus").alias("target")).where("source is not null and source != target").groupBy("source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {_STATES} SELECT source, target, n FROM tr")
def state_transitions(s, d):
    return _transitions(s, d)


@query(f"WITH {_STATES}, x AS (SELECT source, target FROM tr UNION ALL SELECT 'F', 'DONE') SELECT target AS state FROM x EXCEPT SELECT source FROM x")
def state_terminals(s, d):
    tr = _transitions(s, d).select("source", "target").unionByName(s.createDataFrame([("F", "DONE")], "source string, target string"))
    return tr.select(F.col("target").alias("state")).distinct().join(tr.select(F.col("source").alias("state")), "state", "left_anti")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS n_other FROM events GROUP BY user_id")
def timing_counters(s, d):
    kind = F.col("event_type")
    return table(s, d, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("n_click"), F.count_if(kind == "view").alias("n_view"), F.count_if(~kind.isin("click", "view")).alias("n_other"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS ord FROM events")
def event_order(s, d):
    return table(s, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"))


def _messages(s, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("caller"), F.lead("role").over(w).alias("callee")).where("callee is not null")


_MSG = "m AS (SELECT conv_id, turn AS pos, role AS caller, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS callee FROM conversations QUALIFY callee IS NOT NULL)"


@query(f"WITH {_MSG} SELECT conv_id, pos, caller, callee FROM m")
def sequence_messages(s, d):
    return _messages(s, d)


_DEPTH = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END"


@query(
    f"""WITH x AS (SELECT conv_id, turn AS pos, {_DEPTH} AS depth FROM conversations), a AS (SELECT *, sum(CASE WHEN depth < 1 THEN 1 ELSE 0 END) OVER w AS r1, sum(CASE WHEN depth < 2 THEN 1 ELSE 0 END) OVER w AS r2 FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
b AS (SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS n0, sum(CASE WHEN depth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, r1 ORDER BY pos) AS n1, sum(CASE WHEN depth = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, r2 ORDER BY pos) AS n2 FROM a)
SELECT conv_id, pos, CAST(n0 AS VARCHAR) || CASE WHEN depth >= 1 THEN '.' || n1 ELSE '' END || CASE WHEN depth >= 2 THEN '.' || n2 ELSE '' END AS number FROM b"""
)
def message_numbering(s, d):
    depth = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = table(s, d, "conversations").select("conv_id", F.col("turn").alias("pos"), depth.alias("depth"))
    return sequence.number_messages(rows, ["conv_id"], max_depth=2).select("conv_id", "pos", "number")


@query(f"WITH {_MSG}, e AS (SELECT conv_id, caller AS name, pos * 2 AS place FROM m UNION ALL SELECT conv_id, callee, pos * 2 + 1 FROM m) SELECT conv_id, name, min(place) AS first_at FROM e GROUP BY ALL")
def participants(s, d):
    return sequence.participants(_messages(s, d), ["conv_id"]).select("conv_id", "name", (F.col("first.p") * 2 + F.col("first.side")).alias("first_at"))


@query(
    f"""WITH RECURSIVE {_H}, o AS (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY callee) AS pos FROM h), x AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS at_node, []::BIGINT[] AS ord, 0 AS depth, NULL::VARCHAR AS caller FROM region UNION ALL SELECT root, o.callee, list_append(ord, o.pos), depth + 1, o.caller FROM x JOIN o ON o.caller = at_node WHERE depth < 8)
SELECT root, row_number() OVER (PARTITION BY root ORDER BY ord) AS pos, CAST(depth - 1 AS INT) AS depth, caller, at_node AS callee FROM x WHERE depth > 0"""
)
def preorder_expand(s, d):
    calls = edges_h(s, d).withColumn("pos", F.row_number().over(W.partitionBy("caller").orderBy("callee")))
    roots = table(s, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    rows = sequence.preorder(calls, roots)
    return rows.select("root", F.row_number().over(W.partitionBy("root").orderBy("ord")).cast("long").alias("pos"), "depth", "caller", "callee")


@query(f"WITH {_H} SELECT 'R' || r_regionkey AS start, count(*) AS n FROM region JOIN (SELECT a.caller AS root, a.callee AS node FROM h a WHERE starts_with(a.caller, 'R') UNION SELECT a.caller, b.callee FROM h a JOIN h b ON b.caller = a.callee WHERE starts_with(a.caller, 'R')) ON root = 'R' || r_regionkey GROUP BY 1")
def call_chains(s, d):
    calls = edges_h(s, d).select(F.lit("h").alias("graph_id"), "caller", "callee", F.row_number().over(W.partitionBy("caller").orderBy("callee")).alias("pos"))
    starts = table(s, d, "region").select(F.lit("h").alias("graph_id"), F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return sequence.call_chains(calls, starts).groupBy("start").agg(F.count("*").alias("n"))


@query(
    """SELECT coalesce(scope, 'module') AS scope, name, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'U' || (user_id % 5) END AS scope,
CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) END || ' item' AS name FROM events) GROUP BY ALL"""
)
def use_case_groups(s, d):
    handler = F.concat(F.lit("app.on_"), "event_type", F.lit("_item_clicked"))
    rows = table(s, d, "events").groupBy(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("U"), F.col("user_id") % 5)).alias("scope"), "event_type").agg(F.count("*").alias("n"))
    return rows.groupBy(F.coalesce("scope", F.lit("module")).alias("scope"), names.use_case_name(F.lit(None).cast("string"), handler).alias("name")).agg(F.sum("n").alias("n"))


# --- CI and design rules -------------------------------------------------------------------------------------------


def _ci_steps(s, d):
    """Orders of a customer as jobs of a workflow, their line items as steps: R tests, N builds."""
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey").join(line, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("job"), F.col("l_linenumber").alias("pos"), (F.col("l_returnflag") == "R").alias("is_test"), (F.col("l_returnflag") == "N").alias("is_build"), F.concat(F.lit(" make "), "l_suppkey").alias("command"))


_CI = "st AS (SELECT o_custkey AS workflow, o_orderkey AS job, l_linenumber AS pos, l_returnflag = 'R' AS is_test, l_returnflag = 'N' AS is_build, 'make ' || l_suppkey AS command FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"WITH {_CI} SELECT workflow FROM st GROUP BY workflow HAVING NOT bool_or(is_test)")
def ci_missing_test(s, d):
    return evaluate.missing_test(_ci_steps(s, d))


@query(
    f"""WITH {_CI}, j AS (SELECT workflow, job, min(pos) FILTER (WHERE is_build) AS b, min(pos) FILTER (WHERE is_test) AS t FROM st GROUP BY ALL), k AS (SELECT DISTINCT workflow, job, lag(job) OVER (PARTITION BY workflow ORDER BY job) AS need FROM (SELECT DISTINCT workflow, job FROM st))
SELECT workflow, job FROM j WHERE b IS NOT NULL AND (t IS NULL OR t > b) AND EXISTS (SELECT 1 FROM j x WHERE x.workflow = j.workflow AND x.t IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM k JOIN j x ON x.workflow = k.workflow AND x.job = k.need WHERE k.workflow = j.workflow AND k.job = j.job AND x.t IS NOT NULL)"""
)
def ci_build_without_test(s, d):
    steps = _ci_steps(s, d)
    needs = steps.select("workflow", "job").distinct().withColumn("need", F.lag("job").over(W.partitionBy("workflow").orderBy("job"))).where("need is not null")
    return evaluate.build_without_test(steps, needs)


@query(f"WITH {_CI} SELECT workflow, command, count(*) AS n, string_agg(job, ', ' ORDER BY job) AS jobs FROM st GROUP BY ALL HAVING count(*) > 1")
def ci_duplicate_command(s, d):
    found = evaluate.duplicate_commands(_ci_steps(s, d))
    return found


@query("SELECT md5(text) AS key, doc_id, quality FROM (SELECT text, d.doc_id, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id) QUALIFY row_number() OVER (PARTITION BY text ORDER BY quality DESC, doc_id) = 1")
def merge_confidence(s, d):
    rows = table(s, d, "documents").select("doc_id", F.md5("text").alias("key")).join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")
    return evaluate.merge_confident(rows, ["key"], F.col("quality"), ["doc_id"])


@query(
    """WITH sel AS (SELECT DISTINCT p_brand AS selector, 'brand' AS k, p_brand AS v FROM part UNION SELECT p_brand || '/' || p_size, 'brand', p_brand FROM part UNION SELECT p_brand || '/' || p_size, 'size', CAST(p_size AS VARCHAR) FROM part),
lab AS (SELECT p_partkey AS target, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part), need AS (SELECT selector, count(*) AS c FROM sel GROUP BY 1)
SELECT sel.selector, target FROM sel JOIN lab USING (k, v) JOIN need USING (selector) GROUP BY sel.selector, target, c HAVING count(*) = c"""
)
def selector_match(s, d):
    """Selectors of one label (each brand) and of two (each brand and size) against all parts."""
    p = table(s, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    pair = lambda name, k, v: p.select(name.alias("selector"), F.lit(k).alias("k"), F.col(v).alias("v")).distinct()
    both = F.concat_ws("/", "p_brand", "p_size")
    selectors = pair(F.col("p_brand"), "brand", "p_brand").unionByName(pair(both, "brand", "p_brand")).unionByName(pair(both, "size", "p_size"))
    lab = lambda k, v: p.select(F.col("p_partkey").alias("target"), F.lit(k).alias("k"), F.col(v).alias("v"))
    return resolve.selector_matches(selectors, lab("brand", "p_brand").unionByName(lab("size", "p_size")))


@query("WITH x AS (SELECT p_partkey, lower(p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'postgres:16' WHEN 1 THEN 'Redis' WHEN 2 THEN 'kafka' ELSE p_type END) AS v FROM part) SELECT p_partkey, CASE WHEN regexp_matches(v, 'postgres|mysql|mariadb|mongo|sqlite') THEN 'database' WHEN regexp_matches(v, 'redis|memcached') THEN 'cache' WHEN regexp_matches(v, 'rabbitmq|kafka|nats|activemq') THEN 'message-queue' ELSE 'service' END AS kind FROM x")
def classify_service(s, d):
    m = F.col("p_partkey") % 5
    image = F.when(m == 0, "postgres:16").when(m == 1, "Redis").when(m == 2, "kafka").otherwise(F.col("p_type"))
    return table(s, d, "part").select("p_partkey", names.classify_service("p_name", image).alias("kind"))


@query(f"WITH {_H} SELECT 'high-fan-out-callable' AS code, 'warning' AS severity, caller AS subject, CAST(count(DISTINCT callee) AS DOUBLE) AS value FROM h GROUP BY caller HAVING count(DISTINCT callee) >= 5 UNION ALL SELECT 'high-fan-in-callable', 'info', callee, CAST(count(DISTINCT caller) AS DOUBLE) FROM h GROUP BY callee HAVING count(DISTINCT caller) >= 1")
def hub_findings(s, d):
    h = edges_h(s, d)
    return evaluate.hub_findings(graph.fan_in(h), graph.fan_out(h), "callable", 1, 5)


@query(_SCC + ", q AS (SELECT node, coalesce(least(node, min(b)), node) AS c FROM n LEFT JOIN m ON a = node GROUP BY node) SELECT 'strongly-connected-component' AS code, 'warning' AS severity, c AS subject, CAST(count(*) AS DOUBLE) AS value FROM q GROUP BY c HAVING count(*) > 1 OR c IN (SELECT caller FROM e WHERE caller = callee)")
def scc_findings(s, d):
    e = _pendant(s, d)
    return evaluate.scc_findings(graph.strong_components(e), e)


@query(
    f"""WITH {_SERIES}, z AS (SELECT series_root, count(*) AS n FROM series GROUP BY 1), x AS (SELECT CAST(count(*) FILTER (WHERE a.series_root <> b.series_root) AS DOUBLE) / count(*) AS r FROM h JOIN series a ON a.node = caller JOIN series b ON b.node = callee)
SELECT 'large-series' AS code, 'warning' AS severity, series_root AS subject, CAST(n AS DOUBLE) AS value FROM z WHERE n >= 5 UNION ALL SELECT 'cross-series-coupling', 'warning', 'graph', r FROM x WHERE r >= 0.05"""
)
def partition_findings(s, d):
    h = edges_h(s, d)
    series, hubs = partition.partition(h)
    return evaluate.partition_findings(series, hubs, partition.statistics(h, None, series, hubs), 5, 0.05)


@query(
    f"""WITH {_H} SELECT 'node_count' AS metric, CAST((SELECT count(*) FROM (SELECT caller FROM h UNION SELECT callee FROM h)) AS DOUBLE) AS value UNION ALL SELECT 'edge_count', CAST(count(*) AS DOUBLE) FROM h
UNION ALL SELECT 'largest_fan_out', CAST(max(n) AS DOUBLE) FROM (SELECT count(DISTINCT callee) AS n FROM h GROUP BY caller) UNION ALL SELECT 'strongly_connected_component_count', 0"""
)
def design_metrics(s, d):
    h = edges_h(s, d)
    one = lambda name, df, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [one("node_count", graph.endpoints(h), F.count("*")), one("edge_count", h, F.count("*")), one("largest_fan_out", graph.fan_out(h), F.max("fan_out")), one("strongly_connected_component_count", evaluate.scc_findings(graph.strong_components(h), h), F.count("*"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- names, text, output -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'class_' || substr(sha256(p_name), 1, 10) || '_' || CASE WHEN r = '' THEN 'diagram' ELSE r END AS name FROM (SELECT p_partkey, p_name, rtrim(substr(trim(regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g'), '_-'), 1, 80), '_-') AS r FROM part)")
def stable_names(s, d):
    return table(s, d, "part").select("p_partkey", names.stable_output_name("class", "p_name").alias("name"))


_CAMEL = "upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'HTTPServer' || event_type || 'X2Y_zed'"


@query(f"SELECT DISTINCT event_type, array_to_string(list_filter(list_transform(string_split(regexp_replace({_CAMEL}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_'), lambda x: lower(x)), lambda x: x <> ''), ' ') AS a FROM events")
def camel_words_a(s, d):
    name = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 99), F.lit("HTTPServer"), "event_type", F.lit("X2Y_zed"))
    return table(s, d, "events").select("event_type").distinct().select("event_type", F.array_join(names.words_a(name), " ").alias("a"))


@query(f"SELECT DISTINCT event_type, lower(regexp_replace(regexp_replace({_CAMEL}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_+', ' ', 'g')) AS b FROM events")
def camel_words_b(s, d):
    name = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 99), F.lit("HTTPServer"), "event_type", F.lit("X2Y_zed"))
    return table(s, d, "events").select("event_type").distinct().select("event_type", names.words_b(name).alias("b"))


@query(
    """WITH l AS (SELECT doc_id, CAST(i AS INT) AS line, string_split(text, chr(10))[i] AS t FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i))
SELECT doc_id, line, md5(last_value(CASE WHEN trim(t) <> '' THEN trim(t) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS previous FROM l"""
)
def leading_comment(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", (F.col("p") + 1).alias("line"), "t")
    return evaluate.previous_content(lines, ["doc_id"], "line", "t").select("doc_id", "line", F.md5("previous").alias("previous"))


@query("SELECT source || '/' || lang || '/' || (doc_id % 50) AS path, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_outputs(s, d):
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 50).cast("string"))
    return render.duplicate_paths(table(s, d, "documents").select(path.alias("path")))


@query(
    """WITH m AS (SELECT user_id, list_distinct(list(event_type)) AS names FROM events GROUP BY 1)
SELECT user_id, CASE WHEN list_has_any(names, ['load', 'read', 'save', 'write']) THEN 'Handles user data data input and output.' WHEN list_has_any(names, ['update', 'process', 'run', 'execute']) THEN 'Coordinates user data processing.' WHEN list_has_any(names, ['validate', 'check', 'evaluate']) THEN 'Validates or evaluates user data state.' ELSE 'Manages user data state and behavior.' END AS responsibility FROM m"""
)
def responsibility_rows(s, d):
    m = table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    return m.select("user_id", names.responsibility(F.lit("UserData"), F.lit(None).cast("string"), "names").alias("responsibility"))


@query(
    f"""WITH {_T}, n AS (SELECT caller AS node FROM t UNION SELECT callee FROM t), l AS (SELECT 0 AS a, '' AS b, '' AS c, 'flowchart TD' AS line UNION ALL SELECT 1, node, '', '    n_' || regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g') || '["' || node || '"]' FROM n
UNION ALL SELECT 2, caller, callee, '    n_' || regexp_replace(caller, '[^A-Za-z0-9_]', '_', 'g') || ' --> n_' || regexp_replace(callee, '[^A-Za-z0-9_]', '_', 'g') FROM t) SELECT string_agg(line, chr(10) ORDER BY a, b, c) || chr(10) AS content FROM l"""
)
def render_mermaid(s, d):
    return render.call_graph(edges_t(s, d))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 12")
def top_k_files(s, d):
    return table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(12)


@query("SELECT doc_id FROM documents WHERE contains(text, 'Apache') ORDER BY doc_id LIMIT 40")
def bounded_search(s, d):
    return table(s, d, "documents").where(F.col("text").contains("Apache")).select("doc_id").orderBy("doc_id").limit(40)


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))), '|') AS paths FROM pages")
def path_hints(s, d):
    return table(s, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))), "|").alias("paths"))
