"""Queries on graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.sources.tables import table

#: Shared parts that make an edge: for components and labels, for betweenness, for the division.
SHARED, SHARED_MANY, SHARED_CUT = 6, 8, 7
STEPS, WINDOW = 4, 3


def _edges(spark, sf_dir, shared=SHARED):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.cooccurrence_edges(rows, "o_custkey", "l_partkey", shared)


def cooccurrence_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def degrees(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


def label_propagation_5(spark, sf_dir):
    return G.label_propagation(_edges(spark, sf_dir))


def label_communities(spark, sf_dir):
    return G.communities(G.label_propagation(_edges(spark, sf_dir))).select("size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def connected_components(spark, sf_dir):
    return G.connected_components(_edges(spark, sf_dir))


def edge_betweenness(spark, sf_dir):
    return G.edge_betweenness(_edges(spark, sf_dir, SHARED_MANY)).withColumn("betweenness", F.round(F.round("betweenness", 9), 4)).orderBy(F.desc("betweenness"), "src", "dst")


def modularity_score(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return G.modularity(edges, G.label_propagation(edges)).select(F.round("modularity", 6).alias("modularity"))


def girvan_newman(spark, sf_dir):
    return G.girvan_newman(_edges(spark, sf_dir, SHARED_CUT))


def typed_graph_edges(spark, sf_dir):
    return G.typed_edges([
        (table(spark, sf_dir, "customer"), "c_custkey", "user", "c_nationkey", "city"),
        (table(spark, sf_dir, "supplier"), "s_suppkey", "business", "s_nationkey", "city"),
        (table(spark, sf_dir, "nation"), "n_nationkey", "city", "n_regionkey", "region"),
        (table(spark, sf_dir, "part"), "p_partkey", "item", "p_brand", "brand"),
    ])


def _weighted(spark, sf_dir):
    """Suppliers (odd) and parts (even), weighted by the quantity sold, both ways."""
    once = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def weighted_walk(spark, sf_dir):
    return G.weighted_walks(_weighted(spark, sf_dir), STEPS)


def metapath_samples(spark, sf_dir):
    kind = F.when(F.pmod(F.col("node"), F.lit(2)) == 1, "b").otherwise("u")
    found = G.metapath_samples(G.weighted_walks(_weighted(spark, sf_dir), STEPS), kind, WINDOW)
    return found.groupBy("start_node", "end_node", "path").agg(F.count("*").alias("n"))


def _nodes(spark, sf_dir):
    """Ends are drawn from 0 to the largest vec_id."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


def _positives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("start_node"), (F.col("vec_id") * 7 % _nodes(spark, sf_dir)).alias("end_node"), F.col("label").cast("string").alias("path"))


def negative_samples(spark, sf_dir):
    return G.negative_samples(_positives(spark, sf_dir), _nodes(spark, sf_dir))


def metapath_score(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    paths = vectors.where("id < 10").select(F.col("id").cast("string").alias("path"), "vector")
    return G.metapath_score(_positives(spark, sf_dir), vectors, paths).select("start_node", "end_node", "path", F.round("score", 6).alias("score"))


def _e(shared: int) -> str:
    return f"""b AS MATERIALIZED (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    e AS MATERIALIZED (SELECT x.u AS src, y.u AS dst, count(*) AS n FROM b x JOIN b y ON x.i = y.i AND x.u <> y.u GROUP BY 1, 2 HAVING count(*) >= {shared})"""


def _lpa(rounds: int = 5) -> str:
    parts = ["l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS label FROM e)"]
    for k in range(rounds):
        parts.append(f"""l{k + 1} AS MATERIALIZED (SELECT dst AS node, label FROM (SELECT dst, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS k
            FROM e JOIN l{k} ON src = node GROUP BY dst, label) WHERE k = 1)""")
    return ", ".join(parts)


_WEIGHTED = """o AS (SELECT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
    g AS (SELECT src, dst, weight FROM o UNION ALL SELECT dst, src, weight FROM o),
    s AS MATERIALIZED (SELECT src, dst, (sum(weight) OVER w - weight) / sum(weight) OVER (PARTITION BY src) AS low, sum(weight) OVER w / sum(weight) OVER (PARTITION BY src) AS high
    FROM g WINDOW w AS (PARTITION BY src ORDER BY dst))"""
_WALKS = ", ".join(
    ["w0 AS MATERIALIZED (SELECT DISTINCT src AS start, 0 AS step, src AS node FROM s)"]
    + [f"""w{k} AS MATERIALIZED (SELECT start, {k} AS step, dst AS node FROM w{k - 1} JOIN s ON src = node
        AND low <= (start * 48271 + {k * 69621 + 1}) % 1000003 / 1000003.0::DOUBLE AND (start * 48271 + {k * 69621 + 1}) % 1000003 / 1000003.0::DOUBLE < high)""" for k in range(1, STEPS + 1)]
    + ["w AS (" + " UNION ALL ".join(f"SELECT start, CAST(step AS INT) AS step, node FROM w{k}" for k in range(STEPS + 1)) + ")"]
)
_CLASS = "CASE WHEN {0}.node % 2 = 1 THEN 'b' ELSE 'u' END"
_SAMPLES = " UNION ALL ".join(
    "SELECT x0.node AS start_node, x{0}.node AS end_node, {1} AS path FROM w x0 {2}".format(
        d, " || '-' || ".join(_CLASS.format(f"x{k}") for k in range(d + 1)), " ".join(f"JOIN w x{k} ON x{k}.start = x0.start AND x{k}.step = x0.step + {k}" for k in range(1, d + 1)))
    for d in range(1, WINDOW + 1)
)
_POS = "SELECT vec_id AS start_node, vec_id * 7 % 500 AS end_node, CAST(label AS VARCHAR) AS path FROM embeddings"
_PATHS = ", ".join(["p0 AS (SELECT DISTINCT src AS s, src AS t, 0 AS d, CAST(1 AS BIGINT) AS k FROM e)"] + [
    f"""p{i} AS MATERIALIZED (SELECT s, dst AS t, {i} AS d, CAST(sum(k) AS BIGINT) AS k FROM p{i - 1} JOIN e ON src = t
    WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT s, t FROM p{j}' for j in range(i))}) q WHERE q.s = p{i - 1}.s AND q.t = dst) GROUP BY 1, 2)""" for i in range(1, 6)
] + ["p AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(6)) + ")"])

SQL = {
    "cooccurrence_edges": f"WITH {_e(SHARED)} SELECT src, dst, n FROM e",
    "degrees": f"WITH {_e(SHARED)} SELECT src AS node, count(*) AS degree FROM e GROUP BY 1",
    "label_propagation_5": f"WITH {_e(SHARED)}, {_lpa()} SELECT node, label FROM l5",
    "label_communities": f"WITH {_e(SHARED)}, {_lpa()} SELECT CAST(count(*) AS INT) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM l5 GROUP BY label",
    "connected_components": f"""WITH RECURSIVE {_e(SHARED)}, r AS (SELECT DISTINCT src AS node, src AS reached FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reached)
        SELECT node, min(reached) AS component FROM r GROUP BY 1""",
    "edge_betweenness": f"""WITH {_e(SHARED_MANY)}, {_PATHS}
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(round(sum(a.k * c.k / w.k) / 2, 9), 4) AS betweenness
        FROM e JOIN p a ON a.t = src JOIN p c ON c.s = dst JOIN p w ON w.s = a.s AND w.t = c.t AND w.d = a.d + 1 + c.d GROUP BY 1, 2""",
    "modularity_score": f"""WITH {_e(SHARED)}, {_lpa()}, m AS (SELECT count(*) / 2.0::DOUBLE AS m FROM e),
        c AS (SELECT a.label AS c, count(*) AS d, sum(CASE WHEN a.label = b.label THEN 1 ELSE 0 END) / 2.0::DOUBLE AS l FROM e JOIN l5 a ON a.node = src JOIN l5 b ON b.node = dst GROUP BY 1)
        SELECT round(sum(l / m - power(d / (2 * m), 2)), 6) AS modularity FROM c, m""",
    "typed_graph_edges": """WITH o AS (SELECT 'user:' || c_custkey AS a, 'user' AS ac, 'city:' || c_nationkey AS b, 'city' AS bc FROM customer
        UNION SELECT 'business:' || s_suppkey, 'business', 'city:' || s_nationkey, 'city' FROM supplier
        UNION SELECT 'city:' || n_nationkey, 'city', 'region:' || n_regionkey, 'region' FROM nation UNION SELECT 'item:' || p_partkey, 'item', 'brand:' || p_brand, 'brand' FROM part)
        SELECT a AS source_node, ac AS source_class, b AS dest_node, bc AS dest_class, ac || '-' || bc AS edge_class, CAST(1 AS DOUBLE) AS weight FROM o
        UNION SELECT b, bc, a, ac, bc || '-' || ac, CAST(1 AS DOUBLE) FROM o""",
    "weighted_walk": f"WITH {_WEIGHTED}, {_WALKS} SELECT start, step, node FROM w",
    "metapath_samples": f"WITH {_WEIGHTED}, {_WALKS} SELECT start_node, end_node, path, count(*) AS n FROM ({_SAMPLES}) GROUP BY 1, 2, 3",
    "negative_samples": f"""SELECT start_node, CASE WHEN copy = 0 THEN end_node ELSE (start_node * 31 + end_node * 17 + copy * 7919) % 500 END AS end_node, path,
        CAST(copy AS INT) AS copy, CAST(copy = 0 AS INT) AS label FROM ({_POS}), range(6) t(copy)""",
    "metapath_score": f"""WITH s AS ({_POS}), v AS (SELECT vec_id AS id, embedding AS v FROM embeddings),
        x AS (SELECT start_node, end_node, path, unnest(a.v)::DOUBLE AS a, unnest(b.v)::DOUBLE AS b, unnest(g.v)::DOUBLE AS g FROM s JOIN v a ON a.id = start_node JOIN v b ON b.id = end_node
        JOIN v g ON CAST(g.id AS VARCHAR) = path AND g.id < 10)
        SELECT start_node, end_node, path, round(1 / (1 + exp(-sum(CASE WHEN g >= 0 THEN a * b ELSE 0 END))), 6) AS score FROM x GROUP BY 1, 2, 3""",
}

QUERIES = {
    f.__name__: f
    for f in (
        cooccurrence_edges, degrees, label_propagation_5, label_communities, connected_components, edge_betweenness, modularity_score, girvan_newman, typed_graph_edges, weighted_walk,
        metapath_samples, negative_samples, metapath_score,
    )
}
