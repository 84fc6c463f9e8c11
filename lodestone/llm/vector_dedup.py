"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Equal vectors of a label are one class, so copies cost nothing. Classes are put into the inverted
list of their nearest coarse centre. What is left after the centre is cut into subspaces, each coded
by the nearest entry of a codebook. Centres and codebooks are fitted on a bounded sample; every
class is indexed. The lists grow in number as the root of the classes, and so in size: a class
probes a share of all lists, so more of them would mean more copies of each query.

A class probes each list whose cell it comes near to. A vector at distance r may lie beyond the
plane between two cells only if the plane is within r, so cells within r are probed, and no link is
lost, whatever directions the noise has. ``z`` makes it probe less: noise of length r that is spread
evenly over d dimensions moves by about r / sqrt(d) along one direction, and only cells within
``z * r / sqrt(d)`` are probed. In a list, the tables of distances from the
query's residual to all codebook entries give an asymmetric distance; with the length of the coding
error, which is kept for each member, the triangle inequality bounds the true distance, so the
filter loses no pair. What passes is compared by cosine in double precision.

Lists and their queries are cut into blocks, and one task takes one block of each. It returns for
each query the number of its links, and the edges of a spanning forest of the links that it found,
so no group of near copies is ever written out in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop, save
from lodestone.llm.components import connected_components
from lodestone.llm.vectors import k_means, length_of, matrix, nearest, sample, squared_distances, usable


class Quantiser:
    """Coarse centres and residual codebooks for unit vectors."""

    def __init__(self, points: np.ndarray, lists: int, subspaces: int = 8, entries: int = 256):
        size = points.shape[1]
        self.centres = k_means(points, lists)
        rest = points - self.centres[nearest(points, self.centres)[0]]
        edges = np.linspace(0, size, min(subspaces, size) + 1).astype(int)
        self.cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.books = [k_means(rest[:, c], entries) for c in self.cuts]

    def probes(self, units: np.ndarray, reach: float) -> Iterator[tuple[int, list[int]]]:
        """The own list of each vector, and all lists whose cell may hold something within ``reach`` of it."""
        half = (self.centres**2).sum(1) / 2
        step = max(1, (1 << 21) // len(self.centres))
        for at in range(0, len(units), step):
            scores = units[at : at + step] @ self.centres.T - half  # larger for nearer centres
            own = scores.argmax(1)
            rows = np.arange(len(own))
            # a difference of scores over the distance of the centres is the distance to the plane between
            gaps = np.maximum(np.sqrt(squared_distances(self.centres[own], self.centres)), 1e-12)
            away = (scores[rows, own][:, None] - scores) / gaps
            away[rows, own] = 0
            yield from ((int(o), np.nonzero(x <= reach)[0].tolist()) for o, x in zip(own, away, strict=True))

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave."""
        codes = np.stack([squared_distances(rest[:, c], b).argmin(1) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def near(self, query: np.ndarray, codes: np.ndarray, error: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Indices of pairs (query, member) that may lie within ``radius``."""
        total = np.zeros((len(query), len(codes)))
        for s, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += squared_distances(query[:, c], b)[:, codes[:, s]]
        return np.nonzero(total <= (radius + error + 1e-6)[None] ** 2)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest node of each component of the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(label) if r != i]
        label = new


def link_vectors(vectors: DataFrame, *, threshold: float = 0.98, z: float | None = None, lists: int | None = None, least: int = 64, lengths: int = 8, sample_rows: int = 1 << 17, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; links only join rows of equal labels and lengths.

    Rows whose id, label or vector is null, whose vector is zero, or holds null or non-finite
    components, link with nothing: n_links 0, component_id their own id, kept true (null ids: null,
    false). Rows that are repeated are linked with each other. An empty table gives an empty table.
    Other columns are not read.

    Each of the ``lengths`` most frequent numbers of components that has ``least`` classes gets an index:
    ``lists``, or else a fifth of the root of its classes and at least 4, fitted on 16,384 classes or
    eight for each list, ``sample_rows`` at most. Vectors of other lengths are one list for each label
    and length, compared in the same blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    sound = F.coalesce(usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = save(rows.withColumn("sound", sound), "vectors")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    good = rows.where("sound").select("vec_id", "v", "label")
    classes = save(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("d", length_of("v")), "vector-classes")
    models: dict[int, Quantiser] = {}
    for d, count in classes.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "d").limit(lengths).collect():
        wanted = lists or max(4, round(math.sqrt(count) / 5))
        points = sample(classes.where(F.col("d") == d), "rep", "v", min(sample_rows, max(1 << 14, 8 * wanted)))
        points /= np.linalg.norm(points, axis=1)[:, None]
        models[d] = Quantiser(points, min(wanted, max(1, len(points) // 8)))
    model = spark.sparkContext.broadcast(models)  # ``lengths`` of them, of sample_rows / 8 centres at most
    radius = math.sqrt(2 - 2 * threshold)

    def assign(batches):
        for batch in batches:
            for d in sorted(set(batch.column("d").to_pylist())):
                part = batch.filter(pa.compute.equal(batch.column("d"), d))
                found = [(0, [0])] * part.num_rows
                if d in model.value:
                    v = matrix(part.column("v"))
                    reach = radius * (1.0 if z is None else min(1.0, z / math.sqrt(d))) + 1e-6
                    found = list(model.value[d].probes(v / np.linalg.norm(v, axis=1)[:, None], reach))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([o for o, _ in found], pa.int32()), pa.array([p for _, p in found], pa.list_(pa.int32()))], [*names, "list", "probes"])

    names = ["label", "d", "rep", "copies", "v"]
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    indexed = save(classes.select(names).mapInArrow(assign, ", ".join(f"{c} {kinds[c]}" for c in names) + ", list int, probes array<int>"), "vector-index")

    cell = ["label", "d", "list"]
    members = indexed.select("label", "d", "list", "rep", "copies", "v", F.lit(False).alias("asks"))
    queries = indexed.select("label", "d", F.explode("probes").alias("list"), "rep", "copies", "v", F.lit(True).alias("asks"))
    held = members.groupBy(cell).agg(F.count("*").alias("n")).select(*cell, F.ceil(F.col("n") / block).cast("int").alias("m_blocks"))
    asked = queries.groupBy(cell).agg(F.count("*").alias("n")).select(*cell, F.ceil(F.col("n") / block).cast("int").alias("q_blocks"))
    grid = held.join(asked, cell)
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*cell, "m", "q", "rep", "copies", "v", "asks"]
    left = members.join(grid, cell).withColumn("m", mine("m_blocks")).withColumn("q", every("q_blocks")).select(columns)
    right = queries.join(grid, cell).withColumn("q", mine("q_blocks")).withColumn("m", every("m_blocks")).select(columns)

    def compare(group: pa.Table) -> pa.Table:
        q = model.value.get(group.column("d")[0].as_py())
        asks = group.column("asks").to_numpy()
        v = matrix(group.column("v"))
        units = v / np.linalg.norm(v, axis=1)[:, None]
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        a, b = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        out: list[tuple[int, int | None, int]] = []
        if len(a) and len(b):
            if q is not None:
                centre = q.centres[group.column("list")[0].as_py()]
                codes, error = q.codes(units[b] - centre)
            for at in range(0, len(a), 256):
                part = a[at : at + 256]
                if q is None:
                    i, j = np.nonzero(units[part] @ units[b].T >= threshold - 1e-6)
                else:
                    i, j = q.near(units[part] - centre, codes, error, radius)
                i, j = part[i], b[j]
                other = rep[i] != rep[j]
                i, j = i[other], j[other]
                cosine = np.concatenate([np.einsum("ij,ij->i", units[i[k : k + 65536]], units[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
                i, j = i[cosine >= threshold], j[cosine >= threshold]
                if len(i):
                    seen, at_ = np.unique(i, return_inverse=True)
                    sums = np.bincount(at_, weights=copies[j]).astype(np.int64)
                    out += [(int(rep[k]), None, int(n)) for k, n in zip(seen, sums, strict=True)]
                    out += [(x, y, 0) for x, y in _forest(rep[i], rep[j])]
        a_, b_, n_ = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a_, pa.int64()), "b": pa.array(b_, pa.int64()), "n": pa.array(n_, pa.int64())})

    found = save(left.unionByName(right).groupBy(*cell, "m", "q").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    drop(indexed)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"), "a", "b").withColumnRenamed("node", "rep")
    facts = classes.join(links, "rep", "left").join(parts, "rep", "left").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
    )
    linked = good.join(facts, ["label", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
