"""Graphs: co-occurrence edges, label propagation, components, betweenness, division, walks.

Iterative operators cut their lineage with ``checkpoint``, a table in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.scalars import sigmoid, step
from lodestone.sources.tables import checkpoint


def cooccurrence_edges(rows: DataFrame, node: str, item: str, threshold: int) -> DataFrame:
    """src, dst, n, both ways, of nodes that share at least ``threshold`` items.

    An equi-join on the item, in one direction. Nodes with fewer items than the threshold can't have an
    edge and are left out before the join.
    """
    pairs = rows.select(F.col(node).alias("u"), F.col(item).alias("i")).distinct()
    able = pairs.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") >= threshold).select("u")
    pairs = pairs.join(able, "u", "left_semi")
    once = pairs.join(pairs.select(F.col("u").alias("v"), "i"), "i").where("u < v").groupBy("u", "v").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return once.select(F.col("u").alias("src"), F.col("v").alias("dst"), "n").unionByName(once.select(F.col("v").alias("src"), F.col("u").alias("dst"), "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree of edges stored both ways."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label after synchronous rounds: the most frequent label of the neighbours, the least of equals (M6)."""
    edges = checkpoint(edges.select("src", "dst"))
    labels = edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = edges.join(labels, F.col("src") == F.col("node")).groupBy("dst", "label").agg(F.count("*").alias("n"))
        labels = checkpoint(votes.groupBy(F.col("dst").alias("node")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    return labels


def communities(labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """size, members (sorted array), by (size, first member)."""
    made = labels.groupBy(label).agg(F.array_sort(F.collect_list(node)).alias("members"))
    return made.select(F.size("members").alias("size"), "members").orderBy("size", F.col("members")[0])


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of edges stored both ways (J14): least labels move along edges and jump."""
    edges = checkpoint(edges.select("src", "dst"))
    labels = checkpoint(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        near = edges.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = labels.join(near, "node").join(jump, "component").select("node", F.least("component", "near", "jump").alias("component"), (F.least("near", "jump") < F.col("component")).alias("moved"))
        moved = checkpoint(moved)
        labels = moved.select("node", "component")
        if not moved.where("moved").limit(1).count():
            return labels


def _credits(neighbours: dict, root) -> dict:
    """Edge credits of the shortest paths from one root."""
    level, paths, order, queue = {root: 0}, {root: 1}, [root], deque([root])
    while queue:
        at = queue.popleft()
        for to in neighbours[at]:
            if to not in level:
                level[to], paths[to] = level[at] + 1, 0
                order.append(to)
                queue.append(to)
            if level[to] == level[at] + 1:
                paths[to] += paths[at]
    credit, out = dict.fromkeys(order, 1.0), {}
    for node in reversed(order):
        for parent in neighbours[node]:
            if level.get(parent) == level[node] - 1:
                share = credit[node] * paths[parent] / paths[node]
                credit[parent] += share
                out[min(node, parent), max(node, parent)] = share
    return out


def edge_betweenness(edges: DataFrame, roots: int = 64) -> DataFrame:
    """src < dst, betweenness: shortest paths over each edge, half of the sum over all roots (M7).

    Roots are independent: a task gets the adjacency of one component, as no path crosses two, and
    ``roots`` of its nodes, and sums their credits by edge before the shuffle.
    """
    parts = connected_components(edges)
    blocks = parts.groupBy("component").agg(F.ceil(F.count("*") / roots).cast("int").alias("blocks"))
    grouped = edges.join(parts, F.col("src") == F.col("node")).join(blocks, "component").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy("component", "block")
    kind = dict(edges.dtypes)["src"]

    def run(table: pa.Table) -> pa.Table:
        neighbours: dict = {}
        for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
            neighbours.setdefault(a, []).append(b)
        total: dict = {}
        own, step = table.column("block")[0].as_py(), table.column("blocks")[0].as_py()
        for root in sorted(neighbours)[own::step]:
            for edge, share in _credits(neighbours, root).items():
                total[edge] = total.get(edge, 0.0) + share
        keys, node = sorted(total), table.schema.field("src").type
        return pa.table({"src": pa.array([a for a, _ in keys], node), "dst": pa.array([b for _, b in keys], node), "credit": pa.array([total[k] for k in keys], pa.float64())})

    return grouped.applyInArrow(run, f"src {kind}, dst {kind}, credit double").groupBy("src", "dst").agg((F.sum("credit") / 2).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the sum over communities of edges inside / m - (degrees / 2m)^2."""
    total = edges.agg((F.count("*") / 2).alias("m"))
    own = labels.select(F.col("node").alias("src"), F.col("label").alias("c"))
    other = labels.select(F.col("node").alias("dst"), F.col("label").alias("d"))
    by = edges.join(own, "src").join(other, "dst").groupBy("c").agg(F.count("*").alias("degree"), (F.sum(F.when(F.col("c") == F.col("d"), 1).otherwise(0)) / 2).alias("inside"))
    return by.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))  # one row


def _parts(neighbours: dict) -> dict:
    """The least node of each node's component."""
    part: dict = {}
    for start in sorted(neighbours):
        if start not in part:
            part[start], queue = start, [start]
            while queue:
                for to in neighbours[queue.pop()]:
                    if to not in part:
                        part[to] = start
                        queue.append(to)
    return part


def _divide(pairs: list[tuple]) -> dict:
    """The best division of a small graph, given once for each edge."""
    neighbours: dict = {}
    for a, b in pairs:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    degree = {v: len(x) for v, x in neighbours.items()}
    m, left, best, chosen = len(pairs), dict.fromkeys(pairs, 0.0), float("-inf"), {v: v for v in neighbours}
    stale = set(neighbours)  # nodes whose component has lost an edge
    while left:
        part = _parts(neighbours)
        inside, held = dict.fromkeys(part.values(), 0), dict.fromkeys(part.values(), 0)
        for a, b in pairs:
            inside[part[a]] += part[a] == part[b]
        for v, p in part.items():
            held[p] += degree[v]
        score = sum(inside[p] / m - (held[p] / (2 * m)) ** 2 for p in held)
        if score > best + 1e-12:
            best, chosen = score, part
        changed = {part[v] for v in stale}
        total: dict = {}
        for root, p in part.items():
            if p in changed:
                for edge, share in _credits(neighbours, root).items():
                    total[edge] = total.get(edge, 0.0) + share
        left.update((e, v / 2) for e, v in total.items())
        most = max(left.values())
        gone = [e for e, v in left.items() if v >= most - 1e-9]
        stale = {v for e in gone for v in e}
        for a, b in gone:
            del left[a, b]
            neighbours[a].discard(b)
            neighbours[b].discard(a)
    return chosen


def girvan_newman(edges: DataFrame, small: int = 20000) -> DataFrame:
    """node, label of the division with the largest modularity: edges with the largest betweenness go first, ties at once (M7).

    Modularity keeps the degrees and the number of edges of the whole graph; the edgeless rest isn't
    scored. The rounds follow one another, so a graph of at most ``small`` edges, which is counted
    first, is divided in one place; a larger one by distributed rounds.
    """
    whole = checkpoint(edges.select("src", "dst"))
    nodes = whole.select(F.col("src").alias("node")).distinct()
    if whole.limit(2 * small + 1).count() <= 2 * small:
        kind = dict(whole.dtypes)["src"]
        chosen = _divide([(r["src"], r["dst"]) for r in whole.where("src < dst").collect()])
        return edges.sparkSession.createDataFrame(sorted(chosen.items()), f"node {kind}, label {kind}")
    left, best, chosen = whole, float("-inf"), None
    while left.limit(1).count():
        parts = checkpoint(nodes.join(connected_components(left), "node", "left").select("node", F.coalesce("component", "node").alias("label")))
        score = modularity(whole, parts).first()[0]
        if score > best + 1e-12:
            best, chosen = score, parts
        ranked = checkpoint(edge_betweenness(left))
        most = ranked.agg(F.max("betweenness")).first()[0]
        gone = ranked.where(F.col("betweenness") >= most - 1e-9).select("src", "dst")
        both = gone.unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        left = checkpoint(left.join(both, ["src", "dst"], "left_anti"))
    return chosen


def typed_edges(parts: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """source_node, source_class, dest_node, dest_class, edge_class, weight of (rows, source, its class, destination, its class), and each edge turned."""
    out = None
    for rows, a, a_class, b, b_class in parts:
        once = rows.select(
            F.concat(F.lit(f"{a_class}:"), F.col(a).cast("string")).alias("source_node"), F.lit(a_class).alias("source_class"),
            F.concat(F.lit(f"{b_class}:"), F.col(b).cast("string")).alias("dest_node"), F.lit(b_class).alias("dest_class"),
        ).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
        out = once if out is None else out.unionByName(once)
    turned = out.select(F.col("dest_node").alias("source_node"), F.col("dest_class").alias("source_class"), F.col("source_node").alias("dest_node"), F.col("source_class").alias("dest_class"))
    return out.unionByName(turned).distinct().withColumn("edge_class", F.concat_ws("-", "source_class", "dest_class")).withColumn("weight", F.lit(1.0))


def weighted_walks(edges: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """start, step, node: from each source a walk of ``length`` steps at most; a sink ends it.

    The next node is the first, by id, whose running share of the weights exceeds a uniform number that
    an arithmetic hash of (start, step) gives, so a walk is the same on any cluster.
    """
    run = W.partitionBy("src").orderBy("dst")
    shares = edges.withColumn("high", F.sum("weight").over(run)).withColumn("total", F.sum("weight").over(W.partitionBy("src")))
    shares = checkpoint(shares.select("src", "dst", ((F.col("high") - F.col("weight")) / F.col("total")).alias("low"), (F.col("high") / F.col("total")).alias("high")))
    heads = shares.select(F.col("src").alias("start")).distinct().withColumn("node", F.col("start"))
    walks = heads.select("start", F.lit(0).alias("step"), "node")
    for step in range(1, length + 1):
        u = F.pmod(F.col("start") * 48271 + F.lit(step * 69621 + seed), F.lit(1000003)) / F.lit(1000003.0)
        heads = checkpoint(heads.join(shares, F.col("node") == F.col("src")).where((F.col("low") <= u) & (u < F.col("high"))).select("start", F.col("dst").alias("node")))
        walks = walks.unionByName(heads.select("start", F.lit(step).alias("step"), "node"))
    return walks


def metapath_samples(walks: DataFrame, node_class: Column, window: int = 4) -> DataFrame:
    """start_node, end_node, path: pairs up to ``window`` steps apart on a walk with the classes between."""
    own = walks.select("start", "step", "node", node_class.alias("class"))
    run = W.partitionBy("start").orderBy("step").rowsBetween(-window, 0)
    before = own.withColumn("seen", F.collect_list(F.struct("node", "class")).over(run))
    n = F.size("seen")
    back = before.select("node", "seen", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("far")).where(F.col("far") < n)
    path = F.array_join(F.transform(F.slice("seen", n - F.col("far"), F.col("far") + 1), lambda x: x["class"]), "-")
    return back.select(F.element_at("seen", n - F.col("far"))["node"].alias("start_node"), F.col("node").alias("end_node"), path.alias("path"))


def negative_samples(positives: DataFrame, nodes: int, copies: int = 5) -> DataFrame:
    """The positives with label 1, and ``copies`` of each whose end is drawn from 0..nodes-1 by an arithmetic hash, label 0."""
    drawn = F.pmod(F.col("start_node") * 31 + F.col("end_node") * 17 + F.col("copy") * 7919, F.lit(nodes))
    each = positives.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return each.withColumn("end_node", F.when(F.col("copy") == 0, F.col("end_node")).otherwise(drawn)).withColumn("label", (F.col("copy") == 0).cast("int"))


def metapath_score(samples: DataFrame, vectors: DataFrame, paths: DataFrame) -> DataFrame:
    """``samples`` with score: sigmoid of the sum of start x end x step(path) over the places."""
    at = lambda name: vectors.select(F.col("id").alias(f"{name}_node"), F.col("vector").alias(name))
    rows = samples.join(at("start"), "start_node").join(at("end"), "end_node").join(paths.select("path", F.col("vector").alias("gate")), "path")
    product = F.zip_with(F.zip_with("start", "end", lambda a, b: a * b), "gate", lambda x, g: x * step(g))
    dot = F.aggregate(product, F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("score", sigmoid(dot)).drop("start", "end", "gate")
