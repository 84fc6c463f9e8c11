"""Approximate nearest neighbours by learned partitions.

Equal vectors are one class. The classes of one length form the root of a tree. A node is split on a
bounded sample of it: the exact neighbour graph is cut into balanced parts by recursive bisection and
refined by moving classes to the part of most of their neighbours while sizes stay level; a small
network learns each one's part from its vector. Every class of the node then goes to the part that
the network finds most probable, and a query visits its most probable parts. How many it visits is
measured: the fewest that reach the target recall for held-out points of the sample. Nodes that are
still large are split again, so leaves have the same size whatever the table has; each node is
learnt in a task of its own.

Leaves are cut into blocks of rows and blocks of queries; one task takes one block of each, ranks by
inner products and reranks by the distance itself. Each block returns k + 1 classes for a query.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import drop, save
from lodestone.llm.vectors import length_of, matrix, squared_distances, usable


def neighbours(points: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other points of each point, nearest first."""
    found = np.empty((len(points), k), dtype=np.int64)
    for at in range(0, len(points), 512):
        far = squared_distances(points[at : at + 512], points)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        found[at : at + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return found


def balanced_partition(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each node of the neighbour graph: level sizes, few edges between parts."""
    part = np.zeros(len(points), dtype=np.int64)
    work = [(np.arange(len(points)), 0, parts)]
    while work:
        rows, first, n = work.pop()
        if n == 1:
            part[rows] = first
            continue
        centred = points[rows] - points[rows].mean(0)
        axis = np.linalg.svd(centred[:: max(1, len(rows) // 2000)], full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(points.shape[1])
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (n // 2) // n
        work += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    most = int(np.ceil(len(points) / parts * slack))
    sizes = np.bincount(part, minlength=parts)
    edges = [[] for _ in range(len(points))]
    for i, row in enumerate(graph):
        for j in row:
            edges[i].append(j)
            edges[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in range(len(points)):
            votes = np.bincount(part[edges[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and sizes[best] < most:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer that tells the probable parts of a vector."""

    def __init__(self, points: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = points.mean(0), points.std(0) + 1e-9
        x = (points - self.shift) / self.scale
        size = x.shape[1]
        self.w = [rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                logits = h @ self.w[2] + self.w[3]
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), part[rows]] -= 1
                p /= len(rows)
                back = (p @ self.w[2].T) * (h > 0)
                grads = [x[rows].T @ back, back.sum(0), h.T @ p, p.sum(0)]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] -= 0.002 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def order(self, points: np.ndarray) -> np.ndarray:
        """Parts, the most probable first."""
        h = np.maximum((points - self.shift) / self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def learn(points: np.ndarray, parts: int, k: int, target: float, degree: int = 10) -> tuple[Router, int, np.ndarray]:
    """The router, the fewest parts to visit for ``target`` recall among the sample, and the sample's parts.

    A tenth of the sample is held out of the training; its neighbours are sought in all of the sample.
    """
    held = np.arange(len(points)) % 10 == 0
    train = points[~held]
    part = balanced_partition(train, neighbours(train, min(degree, len(train) - 1)), parts)
    router = Router(train, part, parts)
    order = router.order(points)
    own = order[:, 0]
    rows = np.nonzero(held)[0][:1000]
    far = squared_distances(points[rows], points)
    far[np.arange(len(rows)), rows] = np.inf
    near = np.argpartition(far, min(k, len(points) - 2), axis=1)[:, :k]
    rank = np.empty((len(rows), parts), dtype=np.int64)
    np.put_along_axis(rank, order[rows], np.arange(parts)[None], 1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel()) + 1
    return router, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]), own


def tree(index: DataFrame, *, k: int = 10, target: float = 0.97, part_rows: int = 1024, most_parts: int = 64, least: int = 64, sample_rows: int = 8192) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves (node, cls, first, v, asks) and the tables of models (node, n, parts, visits, model), a level each.

    ``index`` has cls, first, v and asks. A row that doesn't ask is in one leaf; one that asks is there
    too, and once more, marked, in each leaf that it visits. A root has at least ``least`` classes to be
    split, a node below twice ``part_rows``; what can't be split is one leaf. A query always visits parts
    that hold 2k + 2 classes, or all.
    """
    columns = ["cls", "first", "v", "asks"]
    root = length_of("v").cast("string").alias("node")
    members = index.select(root, "cls", "first", "v", F.lit(False).alias("asks"))
    state = members.unionByName(index.where("asks").select(root, *columns))
    total = index.groupBy(root).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(2.0, total / part_rows), most_parts)))
    each, enough = target ** (1 / levels), 2 * k + 2

    def train(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        points = matrix(group.sort_by("cls").column("v"))
        parts = max(2, min(most_parts, max(4, -(-n // part_rows)), len(points) // 16))
        router, visits, own = learn(points, parts, k, each)
        model = pickle.dumps((router, np.bincount(own, minlength=parts)))
        return pa.table({"node": group.column("node")[:1], "n": pa.array([n], pa.int64()), "parts": pa.array([parts], pa.int32()), "visits": pa.array([visits], pa.int32()), "model": pa.array([model], pa.binary())})

    def assign(rows: pa.Table, models: pa.Table) -> pa.Table:
        if not rows.num_rows or not models.num_rows:
            return pa.table({"node": pa.array([], pa.string()), **{c: rows.column(c).slice(0, 0) for c in columns}})
        router, held = pickle.loads(models.column("model")[0].as_py())
        order = router.order(matrix(rows.column("v")))
        asks = rows.column("asks").to_numpy()
        reach = np.maximum(models.column("visits")[0].as_py(), (np.cumsum(held[order], 1) < enough).sum(1) + 1)
        times = np.where(asks, np.minimum(reach, len(held)), 1)
        at = np.repeat(np.arange(len(order)), times)
        part = order[at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        node = rows.column("node")[0].as_py()
        return pa.table({"node": pa.array([f"{node}/{p}" for p in part.tolist()], pa.string()), **{c: rows.column(c).take(pa.array(at)) for c in columns}})

    kind = dict(index.dtypes)["v"]
    done, models, spent = None, [], []
    for level in range(levels + 1):
        sizes = state.where("not asks").groupBy("node").agg(F.count("*").alias("n"))
        todo = save(sizes.where(F.col("n") >= (2 * part_rows if level else least)), "search-nodes") if level < levels else None
        if todo is None or not (nodes := todo.count()):
            leaves = state
            done = leaves if done is None else done.unionByName(leaves)
            break
        known = F.broadcast(todo) if nodes <= 50_000 else todo  # a node's path and a count each
        leaves = state.join(known, "node", "left_anti")
        done = leaves if done is None else done.unionByName(leaves)
        more = state.join(known, "node")
        chance = F.pmod(F.xxhash64(F.lit(11 + level), "cls"), F.lit(1 << 31)) < F.lit(sample_rows) * F.lit(1 << 31) / F.col("n")
        learnt = more.where(~F.col("asks") & chance).select("node", "n", "cls", "v").groupBy("node").applyInArrow(train, "node string, n long, parts int, visits int, model binary")
        learnt = save(learnt, "search-models")
        models.append(learnt)
        salts = F.ceil(F.col("n") / (1 << 16)).cast("int")
        dealt = more.withColumn("salt", F.pmod(F.xxhash64("cls"), salts).cast("int")).select("node", "salt", *columns).groupBy("node", "salt")
        copies = learnt.select("node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "visits", "model").groupBy("node", "salt")
        state = save(dealt.cogroup(copies).applyInArrow(assign, f"node string, cls long, first long, v {kind}, asks boolean"), "search-level")
        spent += [todo, state]
    done = save(done, "search-leaves")
    for table in spent:
        drop(table)
    return done, models


def search(vectors: DataFrame, is_query: Column, *, k: int = 10, row_block: int = 8192, query_block: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest by Euclidean distance to each row where ``is_query``.

    ``is_query`` is a condition on vec_id. Rows whose id or vector is null, whose vector is zero, has
    null or non-finite components, take no part; vectors of different lengths aren't compared. Nearest
    first, ties to the smaller vec_id. A query never finds its own row; another row with its id is a
    candidate like any other. Fewer than k candidates are all returned; an empty table gives an empty
    table. Other columns are not read. ``settings`` go to ``tree``.

    Of rows with equal vectors the k + 1 with the least ids stand for all, as no other of them can be
    among the k nearest of any row; so a vector that a third of all rows share costs no more than one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = rows.where(usable("v") & F.col("vec_id").isNotNull())
    rows = save(rows.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("uid")), "search-rows")
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "uid"))
    few = rows.select("v", "vec_id", "uid", place.alias("n")).where(F.col("n") <= k + 1)
    few = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("ids"))  # k + 1 at most
    asked = rows.groupBy("v").agg(F.max("asks").alias("asks"))
    index = save(few.join(asked, "v").select(F.col("ids")[0]["uid"].alias("cls"), F.col("ids")[0]["vec_id"].alias("first"), "v", "ids", "asks"), "search-index")
    leaves, models = tree(index, k=k, **settings)
    for table in models:
        drop(table)

    grid = leaves.groupBy("node").agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("r")).where("q > 0 and r > 0")
    grid = grid.select("node", F.ceil(F.col("q") / query_block).cast("int").alias("query_blocks"), F.ceil(F.col("r") / row_block).cast("int").alias("row_blocks"))
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = leaves.join(grid, "node")
    columns = ["node", "r", "q", "cls", "first", "v", "asks"]
    left = dealt.where("not asks").withColumn("r", mine("row_blocks")).withColumn("q", every("query_blocks")).select(columns)
    right = dealt.where("asks").withColumn("q", mine("query_blocks")).withColumn("r", every("row_blocks")).select(columns)

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        v, ids, first = matrix(group.column("v")), group.column("cls").to_numpy(), group.column("first").to_numpy()
        a, b = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        b = b[np.lexsort((ids[b], first[b]))]
        found: list[tuple[int, int, int, float]] = []
        if len(a) and len(b):
            centre = v[b].mean(0)
            rough = squared_distances(v[a] - centre, v[b] - centre)
            slack = 1e-9 * (1 + ((v - centre) ** 2).sum(1).max())
            for i, row in zip(a, rough, strict=True):
                last = np.partition(row, k)[k] if len(row) > k + 1 else np.inf
                near = b[row <= last + slack]
                score = np.sqrt(((v[near] - v[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], first[near], score))[: k + 1]
                found += [(int(ids[i]), int(ids[near[j]]), int(first[near[j]]), float(score[j])) for j in best]
        q, n, f, s = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"asker": pa.array(q, pa.int64()), "cls": pa.array(n, pa.int64()), "first": pa.array(f, pa.int64()), "score": pa.array(s, pa.float64())})

    best = left.unionByName(right).groupBy("node", "r", "q").applyInArrow(compare, "asker long, cls long, first long, score double")
    top = lambda by, order, n: F.row_number().over(W.partitionBy(by).orderBy("score", *order)) <= n
    best = best.withColumn("in", top("asker", ("first", "cls"), k + 1)).where("in").select("asker", "cls", "score")
    single = best.join(index.select("cls", "ids"), "cls").select("asker", "score", F.explode("ids").alias("id")).select("asker", "score", "id.vec_id", "id.uid")
    single = single.withColumn("in", top("asker", ("vec_id", "uid"), k + 1)).where("in").drop("in")
    askers = rows.where("asks").select("v", F.col("vec_id").alias("query_id"), F.col("uid").alias("own")).join(index.where("asks").select("v", F.col("cls").alias("asker")), "v").drop("v")
    rank = F.row_number().over(W.partitionBy("own").orderBy("score", "vec_id", "uid"))
    return askers.join(single, "asker").where("uid <> own").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
