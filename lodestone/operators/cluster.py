"""Clustering by summaries."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_means(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``points`` (id, features) with cluster, by the library's k-means (M12); k is at most the distinct points."""
    n = points.select("features").distinct().limit(k).count()
    if n < 2:
        return points.withColumn("cluster", F.lit(0))
    rows = points.withColumn("vector", array_to_vector("features"))
    model = KMeans(featuresCol="vector", predictionCol="cluster", k=n, seed=seed, maxIter=10).fit(rows)
    return model.transform(rows).drop("vector")


def summaries(points: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """cluster, place, n, sum, sumsq: counts, sums and sums of squares of every dimension."""
    each = points.select(cluster, F.posexplode(features).alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy(cluster, "place").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def packed(summary: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n, mean, std arrays of a summary; a deviation below 1e-9 is 0."""
    std = F.sqrt(F.greatest(F.col("sumsq") / F.col("n") - F.pow(F.col("sum") / F.col("n"), 2), F.lit(0.0)))
    rows = summary.select(cluster, "n", F.struct("place", (F.col("sum") / F.col("n")).alias("mean"), F.when(std < 1e-9, 0.0).otherwise(std).alias("std")).alias("s"))
    made = rows.groupBy(cluster, "n").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return made.select(cluster, "n", F.transform("s", lambda x: x["mean"]).alias("mean"), F.transform("s", lambda x: x["std"]).alias("std"))


def nearest(points: DataFrame, clusters: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """id, cluster, distance: the nearest summary by the distance in deviations, the smaller id of equals.

    ``clusters`` (cluster, mean, std) are k rows, which each task gets as one array; dimensions without
    spread add nothing.
    """
    models = clusters.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "mean", "std")).alias("models"))  # k rows, a parameter
    z = lambda m: F.zip_with(F.zip_with(F.transform(features, lambda x: x.cast("double")), m["mean"], lambda x, c: x - c), m["std"], lambda d, s: F.when(s > 0, d / s * (d / s)).otherwise(0.0))
    far = F.transform("models", lambda m: F.struct(F.round(F.sqrt(F.aggregate(z(m), F.lit(0.0), lambda a, x: a + x)), 9).alias("distance"), m["c"].alias("cluster")))
    best = F.array_min(far)
    return points.join(F.broadcast(models)).select("id", best["cluster"].alias(cluster), best["distance"].alias("distance"))


def bfr(points: DataFrame, k: int, chunks: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """rounds (round, n_ds, c_cs, n_cs, n_rs) and assignments (id, cluster; -1 for what is in no cluster).

    Chunks are dealt by a hash. The first is clustered into 5k; singletons wait, the rest makes the k
    clusters. In each later round all points of a chunk meet frozen summaries; those within 2 sqrt(d)
    deviations of a cluster join it, or else of a compressed set; the rest waits. What waits is
    clustered again into compressed sets, which are merged when they are near; at the end they join
    near clusters. Compressed sets and clusters are k-sized tables; points stay distributed.
    """
    from lodestone.sources.tables import checkpoint

    spark = points.sparkSession
    rows = checkpoint(points.select("id", "features").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(chunks))))
    first = k_means(rows.where("chunk = 0").select("id", "features"), 5 * k, seed)
    alone = first.groupBy("cluster").agg(F.count("*").alias("m")).where("m = 1").select("cluster")
    waiting = checkpoint(first.join(alone, "cluster", "left_semi").select("id", "features"))
    placed = checkpoint(k_means(first.join(alone, "cluster", "left_anti").select("id", "features"), k, seed).select("id", "features", F.concat(F.lit("d"), "cluster").alias("cluster")))
    d = points.select(F.size("features")).first()
    limit = 2 * math.sqrt(d[0] if d else 1)
    rounds = []
    number = 0

    def compress(waiting, placed):
        nonlocal number
        number += 1
        made = k_means(waiting, 5 * k, seed)
        large = made.groupBy("cluster").agg(F.count("*").alias("m")).where("m > 1").select("cluster")
        new = made.join(large, "cluster", "left_semi").select("id", "features", F.concat(F.lit(f"c{number}_"), "cluster").alias("cluster"))
        return checkpoint(made.join(large, "cluster", "left_anti").select("id", "features")), checkpoint(placed.unionByName(new))

    def merge(placed, kind):
        """Compressed sets to the nearest set of ``kind`` within the limit, each pair once, the nearest first; a k-sized table."""
        sets = {r["cluster"]: r for r in packed(summaries(placed)).collect()}
        pairs = []
        for a, x in sets.items():
            for b, y in sets.items():
                if a != b and a[0] == "c" and b[0] == kind and (kind == "d" or a > b):
                    gap = math.sqrt(sum(((p - q) / s) ** 2 for p, q, s in zip(x["mean"], y["mean"], y["std"], strict=True) if s > 0))
                    if gap < limit:
                        pairs.append((gap, a, b))
        to: dict[str, str] = {}
        for _, a, b in sorted(pairs):
            if a not in to and b not in to and a not in to.values():
                to[a] = b
        if not to:
            return placed
        moves = spark.createDataFrame(sorted(to.items()), "cluster string, target string")
        return checkpoint(placed.join(F.broadcast(moves), "cluster", "left").select("id", "features", F.coalesce("target", "cluster").alias("cluster")))

    for turn in range(chunks):
        if turn:
            new = rows.where(F.col("chunk") == turn).select("id", "features")
            for kind in "dc":
                models = packed(summaries(placed.where(F.col("cluster").startswith(kind))))
                if not models.limit(1).count():
                    continue
                near = checkpoint(new.join(nearest(new, models), "id"))
                placed = placed.unionByName(near.where(F.col("distance") < limit).select("id", "features", "cluster"))
                new = near.where(F.col("distance") >= limit).select("id", "features")
            waiting, placed = checkpoint(waiting.unionByName(new)), checkpoint(placed)
        waiting, placed = compress(waiting, placed)
        if turn:
            placed = merge(placed, "c")
        if turn == chunks - 1:
            placed = merge(placed, "d")
        kind = F.col("cluster").startswith("d")
        s = placed.agg(F.count_if(kind).alias("n_ds"), F.countDistinct(F.when(~kind, F.col("cluster"))).alias("c_cs"), F.count_if(~kind).alias("n_cs")).first()
        rounds.append((turn + 1, s["n_ds"], s["c_cs"], s["n_cs"], waiting.count()))
    out = placed.select("id", F.when(F.col("cluster").startswith("d"), F.substring("cluster", 2, 9).cast("int")).otherwise(-1).alias("cluster"))
    return spark.createDataFrame(rounds, "round int, n_ds long, c_cs long, n_cs long, n_rs long"), out.unionByName(waiting.select("id", F.lit(-1).alias("cluster"))).orderBy("id")
