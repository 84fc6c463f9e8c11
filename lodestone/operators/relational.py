"""Relational operators (SURVEY A, J, O, U, F groups): DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators.streams import numbered


def top_k(df: DataFrame, key: str, k: int = 10, count_name: str = "n") -> DataFrame:
    """The ``k`` most frequent values of ``key``; ties go to the smaller key."""
    return df.groupBy(key).agg(F.count("*").alias(count_name)).orderBy(F.desc(count_name), F.asc(key)).limit(k)


def grouped_mean(df: DataFrame, key: str | list[str], value: Column, name: str, digits: int = 4) -> DataFrame:
    """Mean of ``value`` by ``key``, rounded (A4): partial sums and counts before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.round(F.avg(value), digits).alias(name))


def grouped_means(df: DataFrame, key: str, values: list[str], digits: int = 4) -> DataFrame:
    """Means of several measures by ``key`` in one aggregation (A7), as mean_<measure>."""
    return df.groupBy(key).agg(*(F.round(F.avg(v), digits).alias(f"mean_{v}") for v in values))


def partition_profile(df: DataFrame, partitions: int, by: Column | None = None) -> DataFrame:
    """Rows of each partition after a repartition (X1, X2, A8); empty partitions count 0."""
    dealt = df.repartition(partitions) if by is None else df.repartition(partitions, by)
    counted = dealt.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(counted, "partition", "left").fillna(0, ["n_items"])


def membership(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left`` with a flag whether its key occurs in ``right`` (J7, U4, U5): a semi-join and an anti-join in one pass."""
    keys = right.select(F.col(right_key).alias(left_key)).distinct().withColumn("present", F.lit(True))
    return left.join(keys, left_key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every pair once (U1, U2, U3, U8): pairs are first put in order and deduplicated."""
    once = edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst").distinct()
    return once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def describe(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Count, mean, sample deviation, least and most of numeric columns, a row for each."""
    parts = [
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.round(F.avg(c), digits).alias("mean"), F.round(F.stddev_samp(c), digits).alias("stddev"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"))
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes from 0 in the order of the distinct values (F29, W2): only the distinct values are numbered, by ranges."""
    codes = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=name)
    return df.join(codes.withColumn(name, (F.col(name) - 1).cast("int")), column, "left").select(*df.columns, name)


def minmax_scale(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Columns scaled to 0..1 by extents that are fitted once (M18, A20, D20); a constant column gives 0."""
    extents = df.agg(*(f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))))
    span = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    wide = df.join(F.broadcast(extents))  # one row
    return wide.withColumns({c: F.round(F.when(span(c) != 0, (F.col(c) - F.col(f"lo_{c}")) / span(c)).otherwise(0.0), digits) for c in columns}).select(df.columns)


def mean_vectors(ids: DataFrame, vectors: DataFrame, group: str, key: str, vector: str, digits: int = 4) -> DataFrame:
    """Mean vector of the ids of a group, a row for each place (A18, J4, M23); unknown ids are ignored."""
    found = ids.join(vectors.select(key, vector), key).select(group, F.posexplode(vector).alias("place", "x"))
    return found.groupBy(group, "place").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("mean"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: the value at place n // 2, from 0, of each group in order.

    Equal values are counted first, so a group holds no more than its distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    group = W.partitionBy(key)
    placed = counted.withColumn("_upto", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    return placed.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def group_map(df: DataFrame, key: str, name: str) -> DataFrame:
    """key, counts: a map from each value of ``name`` in a group to its rows (A9); keys of a map are distinct by the count before."""
    counted = df.groupBy(key, name).agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, "_n"))).alias("counts"))


def draw(df: DataFrame, n: int, *key: str, seed: int = 7) -> DataFrame:
    """``n`` rows without replacement, the same at any partitioning: those whose keys have the least digests.

    Rows with equal keys follow in the order of all their columns, so the rows at the limit are fixed too.
    """
    return df.orderBy(F.md5(F.concat_ws("-", *key, F.lit(str(seed)))), *(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)).limit(n)


def draw_again(df: DataFrame, n: int, *order: str, seed: int = 7) -> DataFrame:
    """``n`` draws with replacement: draw, and the row at a place that an arithmetic hash of the draw gives."""
    rows = numbered(df, *order, name="_place")
    total = df.count()
    if not total:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.col("id") * 48271 + seed * 69621, F.lit(1000003)) % total + 1).alias("_place"))
    return draws.join(rows, "_place").drop("_place")
