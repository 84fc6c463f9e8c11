"""Set similarity: exact Jaccard, MinHash signatures and LSH bands."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import PRIME
from lodestone.sources.tables import checkpoint, stored


def coefficients(n: int) -> list[tuple[int, int]]:
    """Fixed (a, b) of n linear hashes, small enough that a * x + b stays in 64 bits for x below 2^31."""
    return [((7919 * (j + 1) * (j + 1) + 104729) % 999983 + 1, (15485863 * (j + 3)) % 999979) for j in range(n)]


#: The most frequent items, which stand as numbers of 16 bits.
FREQUENT = 32768
BITS = 1024


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` places from each of ``low`` on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + count, count)


def similar_pairs(codes: np.ndarray, start: np.ndarray, right: np.ndarray, left: np.ndarray, threshold: float, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``left`` and of smaller or earlier sets in ``right`` of that similarity, and what they have in common.

    Sets stand by rising size, their numbers by rising frequency, as ``jaccard_exact`` has them. Pairs that
    meet in their prefixes are held for a few sets at a time; a pair whose parities of items by 1,024 bits differ in too many places
    cannot be similar, the others are compared.
    """
    size = np.diff(start)
    total, share = len(size), threshold / (1 + threshold)
    prefix = lambda part: (size - np.ceil(size * part - 1e-9) + 1).astype(np.int64)
    few, many = prefix(2 * share), prefix(threshold)
    doc, at = np.repeat(right, few[right]), _ranges(start[right], few[right])
    key = codes[at].astype(np.int64) * total + doc
    order = np.argsort(key)
    key, doc, rest = key[order], doc[order], (start[doc + 1] - at)[order]
    bits = np.zeros((total, BITS // 64), np.uint64)
    for x in range(total):
        place = (codes[start[x] : start[x + 1]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
        bits[x] = np.packbits((np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(bool)).view(np.uint64)
    least = np.searchsorted(size, np.ceil(size * threshold - 1e-9))
    found: list[np.ndarray] = []
    for part in np.array_split(left, max(1, len(left) // 256)):
        owner, place = np.repeat(part, many[part]), _ranges(start[part], many[part])
        code = codes[place].astype(np.int64) * total
        low, high = np.searchsorted(key, code + least[owner]), np.searchsorted(key, code + owner)
        count = np.maximum(high - low, 0)
        cuts = np.searchsorted(np.cumsum(count), np.arange(most, count.sum() + most, most)) if len(count) else []
        kept = []
        for x, y in zip([0, *cuts], [*cuts, len(count)], strict=True):
            of = np.repeat(np.arange(x, y), count[x:y])
            met = _ranges(low[x:y], count[x:y])
            g, h = owner[of], doc[met]
            ok = np.minimum(start[g + 1] - place[of], rest[met]) >= (size[g] + size[h]) * share - 1e-9
            kept.append(np.unique(g[ok] * total + h[ok]))
        pairs = np.unique(np.concatenate(kept))
        for x in range(0, len(pairs), 1 << 18):
            g, h = np.divmod(pairs[x : x + (1 << 18)], total)
            apart = np.bitwise_count(bits[g] ^ bits[h]).sum(1, dtype=np.int64)
            found.append(pairs[x : x + (1 << 18)][size[g] + size[h] - apart >= 2 * ((size[g] + size[h]) * share - 1e-9)])
    g, h = np.divmod(np.concatenate([np.zeros(0, np.int64), *found]), max(total, 1))
    common = _common(codes, start, g, h)
    ok = common >= (size[g] + size[h]) * share - 1e-9
    return g[ok], h[ok], common[ok]


def jaccard_exact(rows: DataFrame, group: str, item: str, threshold: float = 0.5, block: int = 8 << 20) -> DataFrame:
    """a, b, similarity: pairs of groups whose item sets have a Jaccard similarity of ``threshold`` or more.

    Items stand by rising frequency: as hashes of 62 bits, the most frequent as their ranks. Of two similar sets the first item in common stands among
    the first ``n - ceil(t n) + 1`` of the larger set and, as the smaller one must share more of its own,
    among the first ``m - ceil(2t / (1 + t) m) + 1`` of that. Only these are joined, and a pair goes on
    if its sizes fit and what follows the item in either set could still make up the overlap.

    Sets are dealt by size to blocks of about ``block`` items, and each pair of blocks whose sizes fit is one task,
    which joins and compares its sets; only similar pairs leave it. So a set is sent to as many
    tasks as blocks fit its own, however many pairs it meets. Groups are integers.
    """
    kind = rows.schema[group].dataType
    pairs = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).cast("long").alias("g"), F.xxhash64(item).alias("i"))
    often = pairs.groupBy("i").agg(F.count("*").alias("often")).orderBy(F.desc("often"), "i").limit(FREQUENT)
    rank = stored(often.groupBy().agg(F.collect_list("i").alias("top")).select(F.posexplode("top").alias("rank", "i")))
    rare = F.shiftrightunsigned("i", 2)
    codes = pairs.join(F.broadcast(rank), "i", "left").select("g", F.when(F.col("rank").isNull(), rare).otherwise(F.lit(-1) - F.col("rank").cast("long")).alias("code"))
    sets = codes.groupBy("g").agg(F.collect_set("code").alias("items"))

    def pack(batches):
        for batch in batches:
            whole, at = batch.column("items").flatten().to_numpy(), 0
            packed, n = [], np.diff(batch.column("items").offsets.to_numpy())
            for size in n:
                own = np.sort(whole[at : at + size])
                at += size
                common = np.searchsorted(own, 0)  # the rarest of the frequent ones first
                packed.append(own[common:].tobytes() + (own[:common] + FREQUENT).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(n, pa.int64()), pa.array([len(x) for x in packed], pa.int64()), pa.array(packed, pa.binary())], ["g", "n", "bytes", "packed"])

    place = (F.pmod(F.xxhash64("g"), F.lit(1 << 20)) / float(1 << 20)).alias("place")
    sets = stored(sets.mapInArrow(pack, "g long, n long, bytes long, packed binary").select("*", place))
    sizes = np.array(sets.groupBy("n").agg(F.count("*")).orderBy("n").collect(), np.float64).reshape(-1, 2)
    ends = np.cumsum(sizes[:, 0] * sizes[:, 1])
    bounds = np.zeros(0)
    for k in np.arange(block, ends[-1] if len(ends) else 0, block):  # a size may be cut within
        x = np.searchsorted(ends, k)
        bounds = np.append(bounds, sizes[x, 0] + 1 - (ends[x] - k) / (sizes[x, 0] * sizes[x, 1]))
    first, last = np.floor(np.concatenate([[0], bounds])), np.floor(np.concatenate([bounds, [np.inf]]))
    fits = [(i, j) for j in range(len(first)) for i in range(j + 1) if last[i] >= threshold * first[j]]

    def deal(batches):
        for batch in batches:
            own = np.searchsorted(bounds, batch.column("n").to_numpy() + batch.column("place").to_numpy(), side="right")
            for i, j in fits:
                at = np.nonzero((own == i) | (own == j))[0]
                if len(at):
                    some = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(np.full(len(at), j), pa.int32()), pa.array(own[at], pa.int32()), *some.columns], ["i", "j", "own", *some.schema.names])

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("own", "ascending"), ("n", "ascending"), ("place", "ascending"), ("g", "ascending")])
        g, n, own, size = (cell.column(c).to_numpy() for c in ("g", "n", "own", "bytes"))
        rares = (size - 2 * n) // 6
        data = [x.as_buffer() for x in cell.column("packed")]
        heads = [np.frombuffer(x, np.int64, r) for x, r in zip(data, rares, strict=True)]
        known, head = np.unique(np.concatenate(heads), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(n)])
        numbers = np.empty(start[-1], np.int32)
        numbers[_ranges(start[:-1], rares)] = head
        for x, (whole, r) in enumerate(zip(data, rares, strict=True)):
            numbers[start[x] + r : start[x + 1]] = np.frombuffer(whole, np.uint16, n[x] - r, 8 * r).astype(np.int32) + len(known)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        a, b, common = similar_pairs(numbers, start, np.nonzero(own == i)[0], np.nonzero(own == j)[0], threshold)
        return pa.table({"g": pa.array(g[a], pa.int64()), "h": pa.array(g[b], pa.int64()), "n": pa.array(n[a], pa.int64()), "m": pa.array(n[b], pa.int64()), "common": pa.array(common, pa.int64())})

    cells = sets.mapInArrow(deal, "i int, j int, own int, g long, n long, bytes long, packed binary, place double")
    found = stored(cells.groupBy("i", "j").applyInArrow(compare, "g long, h long, n long, m long, common long"))  # a sort of the pairs would compare twice, first for its bounds
    found = found.select("g", "h", _alike(F.col("common"), F.col("n"), F.col("m")).alias("s")).where(F.col("s") >= threshold)
    return found.select(F.least("g", "h").cast(kind).alias("a"), F.greatest("g", "h").cast(kind).alias("b"), F.round("s", 6).alias("similarity"))


def minhash(rows: DataFrame, group: str, item: str | Column, hashes: int = 60) -> DataFrame:
    """group, signature: the least of each linear hash over the group's items, ints below 2^31."""
    x = F.col(item) if isinstance(item, str) else item
    lows = [F.min(F.pmod(F.lit(a) * x + F.lit(b), F.lit(PRIME))) for a, b in coefficients(hashes)]
    return rows.groupBy(group).agg(F.array(*lows).alias("signature"))


def _packed(signature: Column, hashes: int) -> list[Column]:
    """The last four bits of each hash, 15 hashes to a long."""
    found = []
    for low in range(0, hashes, 15):
        parts = [F.shiftleft(signature[j].bitwiseAND(F.lit(15)).cast("long"), 4 * (j - low)) for j in range(low, min(low + 15, hashes))]
        found.append(reduce(lambda x, y: x.bitwiseOR(y), parts))
    return found


def _agreeing(a: str, b: str, hashes: int) -> Column:
    """How many of the packed hashes are equal."""
    apart = None
    for k in range(-(-hashes // 15)):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x111111111111111)))
        apart = x if apart is None else apart + x
    return F.lit(hashes) - apart


def overlap_counts(items: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many items the sets at ``a`` and ``b`` have in common, for each pair of places; pairs are in the order of ``a``."""
    size = np.array([len(x) for x in items], np.int64)
    _, codes = np.unique(np.concatenate(items), return_inverse=True)
    return _common(codes, np.concatenate([[0], np.cumsum(size)]), a, b)


def _common(codes: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """The same for sets of small numbers, one behind the other in ``codes``.

    Each set of ``a`` is marked once, then the items of its partners are looked up, about ``most`` at a time.
    """
    size = np.diff(start)
    marked = np.zeros(codes.max(initial=0) + 1, bool)
    common = np.zeros(len(a), np.int64)
    edges = np.concatenate([[0], np.nonzero(a[1:] != a[:-1])[0] + 1, [len(a)]]) if len(a) else np.zeros(0, np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = codes[start[a[low]] : start[a[low] + 1]]
        marked[own] = True
        step = max(1, most // int(size[b[low:high]].max()))
        for k in range(low, high, step):
            other = b[k : min(high, k + step)]
            ends = np.cumsum(size[other])
            at = np.arange(ends[-1]) + np.repeat(start[other] - ends + size[other], size[other])
            common[k : k + len(other)] = np.add.reduceat(marked[codes[at]], ends - size[other], dtype=np.int64)
        marked[own] = False
    return common


def _alike(common: Column, n: Column, m: Column) -> Column:
    return common / (n + m - common)


def _compared(met: DataFrame, sets: DataFrame, slot_rows: int = 4096) -> DataFrame:
    """g, h, common: the sizes of the intersections of pairs (g, h), each with a ``bucket`` in which both stand.

    A set is sent once to a bucket, however many partners it has there, and buckets share tasks.
    """
    asked = stored(met.select("bucket", F.explode(F.array("g", "h")).alias("g")).distinct().join(sets, "g"))
    slot = F.pmod(F.xxhash64("bucket"), F.lit(max(1, asked.count() // slot_rows))).alias("slot")
    none = F.lit(None)
    rows = met.select(slot, "g", "h", none.cast("array<int>").alias("items")).unionByName(asked.select(slot, "g", none.cast("long").alias("h"), "items").dropDuplicates(["slot", "g"]))

    def compare(group: pa.Table) -> pa.Table:
        is_pair = pc.is_null(group.column("items"))
        whole, pairs = group.filter(pc.invert(is_pair)), group.filter(is_pair).sort_by([("g", "ascending")])
        ids = whole.column("g").to_numpy()
        order = np.argsort(ids)
        items = [np.asarray(x) for x in whole.column("items").combine_chunks().take(pa.array(order)).to_numpy(zero_copy_only=False)]
        g, h = pairs.column("g").to_numpy(), pairs.column("h").to_numpy()
        a, b = np.searchsorted(ids[order], g), np.searchsorted(ids[order], h)
        return pa.table({"g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()), "common": pa.array(overlap_counts(items, a, b) if len(a) else a, pa.int64())})

    return rows.groupBy("slot").applyInArrow(compare, "g long, h long, common long")


def lsh_jaccard(rows: DataFrame, group: str, item: str, threshold: float = 0.5, bands: int = 30, width: int = 2, more: int = 30) -> DataFrame:
    """a, b, similarity of the pairs that share a band of their signatures, verified exactly.

    Sets are built once, of integers below 2^31; equal sets are one class, whose pairs are written out at the end. A pair
    that meets in a band goes on if its sizes fit and as many of its hashes, and of ``more`` others that
    make no bands, agree by four bits each, as all but a few in a million pairs at the threshold have. A
    whole set is fetched once for each band value in which it is compared. Groups are integers.
    """
    used, hashes = bands * width, bands * width + more
    kind = rows.schema[group].dataType
    sets = checkpoint(rows.groupBy(F.col(group).cast("long").alias("g")).agg(F.collect_set(F.col(item).cast("int")).alias("items")))
    signed = minhash(sets.select("g", F.explode("items").alias("x")), "g", F.col("x").cast("long"), hashes)
    sizes = sets.select("g", F.size("items").alias("n"), F.md5(F.array_join(F.array_sort("items"), ",").cast("binary")).alias("print"))
    parts = F.array(*(F.xxhash64(F.lit(k), F.slice("signature", k * width + 1, width)) for k in range(bands)))
    signed = stored(signed.join(sizes, "g").select("g", "n", "print", parts.alias("parts"), *(p.alias(f"p{k}") for k, p in enumerate(_packed(F.col("signature"), hashes)))))
    classes = stored(signed.groupBy("print").agg(F.min("g").alias("g"), F.first("n").alias("n"), F.collect_list("g").alias("members")).select("g", "n", "members"))
    packs = [c for c in signed.columns if c[0] == "p" and c[1:].isdigit()]
    banded = signed.join(classes.select("g"), "g", "left_semi").select("g", "n", *packs, F.explode("parts").alias("bucket"))
    x, y = banded.alias("x"), banded.alias("y")
    same = threshold + (1 - threshold) / 16
    least = hashes * same - 4.5 * math.sqrt(hashes * same * (1 - same))
    fits = F.expr("x.g < y.g") & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")) & (_agreeing("x.p", "y.p", hashes) >= least)
    met = x.join(y, F.expr("x.bucket = y.bucket") & fits).groupBy(F.col("x.g").alias("g"), F.col("y.g").alias("h")).agg(F.min("x.bucket").alias("bucket"))
    common = _compared(stored(met), sets)
    one, two = classes.toDF("g", "n", "left"), classes.toDF("h", "m", "right")
    found = common.join(one.drop("left"), "g").join(two.drop("right"), "h").select("g", "h", _alike(F.col("common"), F.col("n"), F.col("m")).alias("s")).where(F.col("s") >= threshold)
    apart = found.join(one, "g").join(two, "h").select("s", "right", F.explode("left").alias("g")).select("s", "g", F.explode("right").alias("h"))
    equal = classes.where(F.size("members") > 1).select("members", F.explode("members").alias("g")).select(F.lit(1.0).alias("s"), "g", F.explode("members").alias("h")).where("g < h")
    return apart.unionByName(equal).select(F.least("g", "h").cast(kind).alias("a"), F.greatest("g", "h").cast(kind).alias("b"), F.round("s", 6).alias("similarity"))
