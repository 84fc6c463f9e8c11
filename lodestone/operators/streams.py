"""Summaries of a stream in batch form: Bloom filter, Flajolet-Martin, reservoir.

Each works on rows numbered by ``numbered``; what a sequential program keeps as state is written as a
first or last position, so the work spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.scalars import hashed, linear_hashes, trailing_zeros
from lodestone.sources.tables import checkpoint

#: Bits of the filter.
BITS = 69997


def numbered(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """``df`` with its place from 1 in the given total order (W3), without one task that holds all rows.

    Rows are dealt by ranges, numbered in each partition, and moved by the rows of the ones before.
    """
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))  # a row for each partition
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(before.drop("_n")), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def bloom_by_window(rows: DataFrame, user: str, size: int, hashes: int = 50, bits: int = BITS) -> DataFrame:
    """window, unseen, false_positives, fpr: tests before inserts, with state kept across windows (M8).

    A row is a false positive iff it is its user's first and each of its bits was set before it: the
    first position that sets a bit is the least ``seq`` of the bit. Rows need ``seq``.
    """
    first = rows.groupBy(user).agg(F.min("seq").alias("seq"))
    tested = first.select("seq", F.explode(F.array_distinct(hashed(F.col(user), linear_hashes(hashes, bits), bits))).alias("bit"))
    set_at = tested.groupBy("bit").agg(F.min("seq").alias("set_at"))
    verdict = tested.join(set_at, "bit").groupBy("seq").agg((F.max("set_at") < F.col("seq")).alias("false_positive"))
    window = F.floor((F.col("seq") - 1) / size)
    counted = verdict.groupBy(window.alias("window")).agg(F.count("*").alias("unseen"), F.count_if("false_positive").alias("false_positives"))
    every = rows.select(window.alias("window")).distinct().join(counted, "window", "left").fillna(0, ["unseen", "false_positives"])
    return every.withColumn("fpr", F.col("false_positives") / F.nullif(F.col("unseen"), F.lit(0)))


def distinct_by_window(rows: DataFrame, user: str, size: int, hashes: int = 50, modulus: int = 997) -> DataFrame:
    """window, truth, estimate: the mean over the hashes of 2^R, R the most trailing zeros in the window (M9)."""
    window = F.floor((F.col("seq") - 1) / size).alias("window")
    own = rows.select(window, user).distinct()
    longest = own.select("window", F.posexplode(hashed(F.col(user), linear_hashes(hashes, modulus), modulus)).alias("j", "h")).groupBy("window", "j").agg(F.max(trailing_zeros(F.col("h"))).alias("r"))
    estimate = longest.groupBy("window").agg(F.floor(F.sum(F.pow(F.lit(2.0), "r")) / hashes).cast("long").alias("estimate"))
    return own.groupBy("window").agg(F.count("*").alias("truth")).join(estimate, "window")


def reservoir_snapshots(rows: DataFrame, user: str, size: int = 100, every: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """n, slot, user after each ``every`` rows.

    Row n of the first ``size`` takes slot n - 1; a later one is accepted with chance size / n and takes
    a uniform slot, both by arithmetic hashes of n. A slot holds the last accepted row's user.
    """
    n = F.col("seq")
    accepted = F.pmod(n * 48271 + 11, F.lit(1000003)) / F.lit(1000003.0) < F.lit(size) / n
    slot = F.when(n <= size, n - 1).when(accepted, F.pmod(n * 69621 + 7, F.lit(size)))
    taken = rows.select(n.alias("n"), slot.cast("int").alias("slot"), F.col(user).alias("user")).where(F.col("slot").isin(*slots)).withColumn("asks", F.lit(0))
    marks = rows.where(n % every == 0).select(n.alias("n"), F.explode(F.array(*map(F.lit, slots))).alias("slot")).withColumn("user", F.lit(None).cast(dict(rows.dtypes)[user])).withColumn("asks", F.lit(1))
    last = F.last("user", ignorenulls=True).over(W.partitionBy("slot").orderBy("n", "asks"))
    return taken.unionByName(marks).withColumn("user", last).where("asks = 1").drop("asks")


def running_distinct(rows: DataFrame, user: str, size: int) -> DataFrame:
    """window, new, seen: users that come first in a window, and all users up to its end (W6). Rows need ``seq``.

    The running sum is taken in ranges of windows, each moved by the sum of the ones before.
    """
    window = F.floor((F.col("seq") - 1) / size)
    first = rows.groupBy(user).agg(F.min("seq").alias("seq")).groupBy(window.alias("window")).agg(F.count("*").alias("new"))
    every = rows.select(window.alias("window")).distinct().join(first, "window", "left").fillna(0, ["new"])
    dealt = checkpoint(every.repartitionByRange("window").withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.sum("new").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each partition
    own = F.sum("new").over(W.partitionBy("_part").orderBy("window"))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").select("window", "new", (F.col("_own") + F.col("_before")).alias("seen"))
