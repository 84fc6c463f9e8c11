"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Documents with equal texts form a group. A group is a point of the tree: its dimensions are the
source, the language and the size, each followed by bits of the text's hash, so that no two groups
tie and a source that holds a third of the corpus can still be cut. The tree halves the shards of a
node, and cuts the node's groups at the distributed weighted median of the node's widest dimension:
bytes left and right are in proportion to the capacity of the shards on either side. The median is
found by histograms that get narrower, so the driver only sees bins.

Groups of at least ``heavy`` of a shard's target (by their definition at most ``shards / heavy`` of
them) would spoil a median whichever side they fall. They are dealt out first, largest first to the
emptiest shard, and take up capacity; the tree fills what is left. A group that is larger than a
whole shard is cut into parts, as no shard can hold it.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import drop, save

#: Bits of a dimension's value, and of the hash that follows it.
VALUE_BITS, TIE_BITS = 20, 32
DIMENSIONS = ("source", "lang", "size")
KEY = ["text_hash", "text_crc32", "size"]


def _hashed(name: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), 64 - VALUE_BITS)


def _points(groups: DataFrame) -> DataFrame:
    """One integer coordinate per dimension, of VALUE_BITS + TIE_BITS bits."""
    tie = F.shiftrightunsigned(F.xxhash64(*KEY), 64 - TIE_BITS)
    values = {
        "source": _hashed("source"),
        "lang": _hashed("lang"),
        "size": F.least(F.floor(F.log2(F.col("size").cast("double")) * 2**14), F.lit(2**VALUE_BITS - 1)).cast("long"),
    }
    return groups.select(*KEY, "bytes", *((v * F.lit(2**TIE_BITS) + tie).alias(f"at_{k}") for k, v in values.items()))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows of whole numbers as a table, without Python: keys are longs, the others ints."""
    kinds = ["BIGINT" if n in KEY else "INT" for n in names]
    values = ", ".join("(" + ", ".join(f"CAST({v} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def _quantiles(points: DataFrame, node: Column, cuts: dict[int, tuple[str, int, int, float]], bins: int, slack: float) -> dict[int, int]:
    """For each node (dimension, least, most, bytes wanted at or below) the coordinate to cut after."""
    found: dict[int, int] = {}
    todo = {n: (d, lo, hi, want) for n, (d, lo, hi, want) in cuts.items()}
    while todo:
        width = {n: max(1, -(-(hi - lo + 1) // bins)) for n, (_, lo, hi, _) in todo.items()}
        at, kept = None, None
        for n, (d, lo, hi, _) in todo.items():
            c = F.col(f"at_{d}")
            inside = (F.col("node") == n) & c.between(lo, hi)
            bin_ = F.expr(f"(at_{d} - {lo}L) div {width[n]}L")
            at = F.when(inside, bin_) if at is None else at.when(inside, bin_)
            kept = inside if kept is None else kept | inside
        rows = (
            points.withColumn("node", node).where(kept).groupBy("node", at.alias("bin"))
            .agg(F.sum("bytes").alias("bytes")).collect()
        )
        weights: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            weights.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for n, (d, lo, hi, want) in list(todo.items()):
            below, chosen = 0, None
            for b, w in sorted(weights.get(n, [])):
                if below + w >= want:
                    chosen = (b, w)
                    break
                below += w
            if chosen is None:
                found[n] = hi
                del todo[n]
                continue
            b, w = chosen
            start = lo + b * width[n]
            end = min(hi, start + width[n] - 1)
            if start == end or w <= slack:
                found[n] = end if want - below > w / 2 else start - 1
                del todo[n]
            else:
                todo[n] = (d, start, end, want - below)
    return found


def _grow(points: DataFrame, capacity: list[float], bins: int, slack: float) -> Column:
    """The shard of a point as nested conditions: one level of the tree for each pass."""
    shards = {0: list(range(len(capacity)))}
    tree: dict[int, tuple[str, int, int, int]] = {}

    def label(leaf, at: int = 0) -> Column:
        if at not in tree:
            return F.lit(leaf(at))
        d, cut, left, right = tree[at]
        return F.when(F.col(f"at_{d}") <= F.lit(cut), label(leaf, left)).otherwise(label(leaf, right))

    spans: dict[str, float] | None = None
    while open_ := [n for n, s in shards.items() if n not in tree and len(s) > 1]:
        node = label(lambda n: n)
        stats = (
            points.withColumn("node", node).where(F.col("node").isin(open_)).groupBy("node")
            .agg(F.sum("bytes").alias("bytes"), *(f(f"at_{d}").alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))))
            .collect()
        )
        if spans is None:
            spans = {d: max(1, *(r[f"hi_{d}"] - r[f"lo_{d}"] for r in stats)) if stats else 1 for d in DIMENSIONS}
        of = {r["node"]: r for r in stats}
        cuts = {}
        for n in open_:
            mine = shards[n]
            half = mine[: len(mine) // 2]
            if n not in of:
                tree[n] = (DIMENSIONS[0], -1, 2 * n + 1, 2 * n + 2)
                continue
            r = of[n]
            d = max(DIMENSIONS, key=lambda x: (r[f"hi_{x}"] - r[f"lo_{x}"]) / spans[x])
            room = sum(capacity[s] for s in mine)
            part = sum(capacity[s] for s in half) / room if room else len(half) / len(mine)
            cuts[n] = (d, r[f"lo_{d}"], r[f"hi_{d}"], r["bytes"] * part)
        at = _quantiles(points, node, cuts, bins, slack)
        for n in open_:
            if n in at:
                tree[n] = (cuts[n][0], at[n], 2 * n + 1, 2 * n + 2)
            mine = shards[n]
            shards[2 * n + 1], shards[2 * n + 2] = mine[: len(mine) // 2], mine[len(mine) // 2 :]
    return label(lambda n: shards[n][0])


def shard_documents(docs: DataFrame, *, shards: int = 24, heavy: float = 0.02, bins: int = 2048, slots: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes (law ``bytes``).

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (gapless
    from 0 in a shard) and grown_shard (null: the law is not ``key``).

    Null texts count as empty (size 8, checksum 0). Null source or lang is a value of its own. Rows
    that are repeated are rows of one group and get a slot each. An empty table gives an empty table.
    Other columns of ``docs`` are not read. Equal texts share a shard unless they outweigh one.

    Only bins, node extents and the heavy groups reach the driver: ``bins`` x ``shards`` and
    ``shards / heavy`` rows at most, at any input size. Slots are counted in ``slots`` parts of a
    shard, each numbered on its own and moved by the rows before it.
    """
    from_text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(from_text) + 8).cast("long").alias("size"),
            F.crc32(from_text.cast("binary")).alias("text_crc32"), F.xxhash64(from_text).alias("text_hash"),
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    points = save(_points(groups.withColumn("bytes", F.col("n") * F.col("size"))), "shard-points")
    total = points.agg(F.sum("bytes")).first()[0] or 0
    target = max(1.0, total / shards)

    large = points.where(F.col("bytes") >= heavy * target).select(*KEY, "bytes").collect()
    parts = {tuple(r[k] for k in KEY): (1 if r["bytes"] <= target else math.ceil(2 * r["bytes"] / target)) for r in large}
    spark = docs.sparkSession
    part_of = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    weights = {(*(r[k] for k in KEY), 0): r["bytes"] for r in large if r["bytes"] <= target}
    if cut := [(*k, p) for k, p in parts.items() if p > 1]:
        many = _table(spark, cut, [*KEY, "parts"])
        for r in rows.join(F.broadcast(many), KEY).groupBy(*KEY, part_of.alias("part")).agg(F.sum("size").alias("bytes")).collect():
            weights[(*(r[k] for k in KEY), r["part"])] = r["bytes"]

    filled = [(0, s) for s in range(shards)]
    dealt = []
    for key, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        held, s = heapq.heappop(filled)
        heapq.heappush(filled, (held + weight, s))
        dealt.append((*key, parts[key[:3]], s))
    capacity = [0.0] * shards
    for held, s in filled:
        capacity[s] = max(0.0, target - held)

    light = points.where(F.col("bytes") < heavy * target)
    shard = _grow(light, capacity, bins, slack=target * 1e-4)
    seats = _table(spark, dealt, [*KEY, "part", "parts", "shard"]) if dealt else None
    owners = seats.select(*KEY, "parts").distinct() if dealt else None
    # heavy groups go before the shuffle: shards / heavy keys at most
    others = rows.join(F.broadcast(owners), KEY, "left_anti") if dealt else rows
    placed_light = others.join(light.select(*KEY, shard.cast("int").alias("shard")), KEY)
    placed = placed_light.select("doc_id", "size", "text_crc32", "shard", "row")
    if dealt:
        apart = rows.join(F.broadcast(owners), KEY).withColumn("part", part_of).join(F.broadcast(seats.drop("parts")), [*KEY, "part"])
        placed = placed.unionByName(apart.select("doc_id", "size", "text_crc32", "shard", "row"))
    placed = save(placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int")), "shard-placed")
    drop(rows)
    drop(points)

    before = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    )
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "row"))
    return (
        placed.withColumn("place", place)
        .join(F.broadcast(before), ["shard", "bucket"])  # at most shards x slots rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
