"""Baskets and frequent itemsets."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import checkpoint


def baskets(rows: DataFrame, group: str, item: str, more_than: int = 0) -> DataFrame:
    """group, items: the distinct items of each group in order, of groups with more than ``more_than``."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("items")).where(F.size("items") > more_than)


def frequent_itemsets(rows: DataFrame, group: str, item: str, support: int, most: int | None = None) -> DataFrame:
    """size, items, freq of itemsets in at least ``support`` groups, of up to ``most`` items if it is given (M2).

    Level by level: only items that are frequent on their own are joined, and each level extends the
    frequent sets of the one before, so infrequent pairs never meet a third item. Counts are summed
    before the shuffle. Without ``most`` each level is written, and the first one without sets is the
    last. ``items`` is a sorted array.
    """
    pairs = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    single = pairs.groupBy("i").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    pairs = pairs.join(single.select("i"), "i", "left_semi")
    if most is None:
        pairs = checkpoint(pairs)
    found = single.select(F.array("i").alias("items"), "freq")
    level = pairs.select("g", F.array("i").alias("items"))
    result, size = found, 1
    while most is None or size < most:
        size += 1
        wider = level.join(pairs, "g").where(F.col("i") > F.element_at("items", -1)).select("g", F.concat("items", F.array("i")).alias("items"))
        found = wider.groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
        if most is None:
            found = checkpoint(found)
            if found.isEmpty():
                break
        result = result.unionByName(found)
        if size != most:
            level = wider.join(found.select("items"), "items", "left_semi")
            if most is None:
                level = checkpoint(level)
    return result.select(F.size("items").alias("size"), "items", "freq")


def fp_growth(rows: DataFrame, group: str, item: str, support: int) -> DataFrame:
    """The same for all sizes by FP-growth, whose fraction is set low and the count filtered again (M2)."""
    made = baskets(rows, group, item)
    n = made.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "size int, items array<string>, freq long")
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(made).freqItemsets
    return found.where(F.col("freq") >= support).select(F.size("items").alias("size"), F.array_sort("items").alias("items"), "freq")


def pair_buckets(rows: DataFrame, group: str, item: str, buckets: int = 1000) -> DataFrame:
    """bucket, n: pairs of items of a group by the hash ``(i XOR j) mod buckets`` (M3)."""
    pairs = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    other = pairs.select("g", F.col("i").alias("j"))
    both = pairs.join(other, "g").where("i < j")
    return both.groupBy(F.pmod(F.col("i").bitwiseXOR(F.col("j")), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def containment(candidates: DataFrame, rows: DataFrame, group: str, item: str) -> DataFrame:
    """candidate, n: how many groups hold all items of a candidate array (J10), by one equi-join on items."""
    wanted = candidates.select("candidate", F.size("candidate").alias("need"), F.explode("candidate").alias("i"))
    pairs = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    held = pairs.join(wanted, "i").groupBy("candidate", "need", "g").agg(F.count("*").alias("have")).where("have = need")
    return candidates.join(held.groupBy("candidate").agg(F.count("*").alias("n")), "candidate", "left").fillna(0, ["n"])
