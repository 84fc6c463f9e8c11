"""Similarity join of word n-gram sets by chosen paths, with exact verification.

A document is the set of hashes of its runs of five words. Documents with equal sets are one class.
For each run and level a set samples its own tokens: those whose hash for that run and level is
below ``branching / size``. Sets that sampled the same token share a bucket, so similar sets meet
often and others rarely; a bucket of more than ``bucket`` sets is split again by the tokens sampled
at the next level. The number of levels grows with the logarithm of the rows, as each one leaves a
bucket a small part of its sets, unless they are near copies, which no token tells apart: those are
compared in blocks. The number of runs follows from the levels and the target recall.

In a bucket, sets are compared by sketches of 64 bytes whose threshold lies four standard deviations
below the wanted similarity; what passes is written as the edges of a spanning forest, so no bucket
ever writes all its pairs; a set is compared only with those that no edge has reached yet. Sets that these edges connect are a cluster: each set goes once to its
cluster, where all pairs are compared exactly, in blocks, as products of incidence matrices. So the
result has exact similarities only, and also the links within a cluster that no run had met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop, pieces, save, text_of
from lodestone.llm.components import connected_components

SKETCH = 64
#: Cells of more sets than this are walked, smaller ones are compared together.
WALKED = 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a shorter text is one run, one without words none."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    grams = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        grams = grams * STEP + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(grams + np.uint64(n)))


class Sampler:
    """Sketches and the tokens that a set samples for each run and level."""

    def __init__(self, runs: int, levels: int, branching: float, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.turns = rng.integers(0, 2**63, runs * levels, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.runs, self.levels, self.branching = runs, levels, branching

    def sketch(self, tokens: np.ndarray) -> bytes:
        least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(tokens), 4096):
            least = np.minimum(least, (tokens[at : at + 4096, None] * self.odd).min(0))
        return _mixed(least).astype(np.uint8).tobytes()

    def paths(self, tokens: np.ndarray) -> list[list[list[int]]]:
        """By run, by level: the sampled tokens."""
        below = np.uint64(min(2**64 - 1, int(2**64 * self.branching / len(tokens)))) if len(tokens) else np.uint64(0)
        found = []
        for turn in self.turns:  # tokens are mixed hashes, so a product's high bits are a hash of its own
            chosen = tokens[tokens * turn <= below] if len(tokens) > self.branching else tokens
            found.append(chosen.view(np.int64).tolist())
        return [found[r * self.levels : (r + 1) * self.levels] for r in range(self.runs)]


def runs_for(recall: float, threshold: float, branching: float, levels: int) -> int:
    """Runs until a pair at the threshold has met, with probability ``recall``, in the smallest buckets of a run."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - math.exp(-branching * threshold * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least of its component in the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(nodes):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def bucket_pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs with equal keys in a sorted array, some at a time."""
    at = np.arange(len(keys))
    for d in range(1, len(keys)):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            return
        for k in range(0, len(at), 1 << 16):
            yield at[k : k + (1 << 16)], at[k : k + (1 << 16)] + d


def walk(sketch: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near sketches in ``left``, or between ``left`` and ``right``.

    Each set that is reached is compared with those not reached yet, and with no other: a group of near
    copies costs one comparison for each of its sets, not one for each pair.
    """
    unseen = [left, left if right is None else right]
    held = [sketch[x] for x in unseen]
    sizes = [size[x] for x in unseen]
    found_a, found_b = [], []

    def reach(side: int, keep: np.ndarray) -> None:
        for s in (0, 1) if right is None else (side,):
            unseen[s], held[s], sizes[s] = unseen[s][keep], held[s][keep], sizes[s][keep]

    while len(unseen[0]) and len(unseen[1]):
        queue = [(unseen[0][0], 0)]
        reach(0, np.arange(len(unseen[0])) > 0)
        while queue:
            x, side = queue.pop()
            other = side if right is None else 1 - side
            if not len(unseen[other]):
                continue
            near = (held[other] == sketch[x]).sum(1) >= enough
            near &= np.minimum(sizes[other], size[x]) >= threshold * np.maximum(sizes[other], size[x])
            if near.any():
                new = unseen[other][near]
                found_a.append(np.full(len(new), x))
                found_b.append(new)
                queue += [(y, other) for y in new]
                reach(other, ~near)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices over some tokens at a time."""
    a = np.concatenate(left)
    b = a if right is left else np.concatenate(right)
    shared = np.unique(a) if right is left else np.intersect1d(a, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    found = np.zeros((len(left), len(right)), np.float32)

    def placed(tokens, rows):
        at = np.searchsorted(shared, tokens)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == tokens[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    at_a, row_a = placed(a, row_a)
    at_b, row_b = placed(b, row_b)
    for low in range(0, len(shared), width):
        one, two = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        i, j = np.searchsorted(at_a, [low, low + width])
        one[row_a[i:j], at_a[i:j] - low] = 1
        i, j = np.searchsorted(at_b, [low, low + width])
        two[row_b[i:j], at_b[i:j] - low] = 1
        found += one @ two.T
    return found


def levels_for(rows: int, bucket: int) -> int:
    """Levels after which even a token that all rows hold has left buckets of ``bucket`` sets, if each level divides by 64."""
    return max(3, 1 + math.ceil(math.log(max(1.0, rows / bucket), 64)))


def _blocks(rows: DataFrame, key: str, block: int, weight: Column | None = None, most: int = 1) -> DataFrame:
    """Each row once for each pair of blocks of its key that it belongs to: i, j with i <= j, and its own block.

    A block has about ``block`` rows, and ``most`` of ``weight`` if that is given.
    """
    heavy = F.lit(0) if weight is None else F.ceil(F.sum(weight) / most)
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"), heavy.alias("heavy")).where(F.col("n") > 1).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), "heavy").cast("int"))
    return _dealt(rows.join(sizes.select(key, "blocks"), key))


def _dealt(rows: DataFrame) -> DataFrame:
    """What ``_blocks`` returns, of rows that know the number of blocks of their key."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _keyed(id_col: str, text_col: str) -> list:
    text = text_of(text_col)
    return [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("key"), text.alias("text")]


def join_documents(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.999, branching: float = 1.6, levels: int | None = None, block: int = 512, bucket: int = 2048, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, key (digest of the text), class_id, n_links, component_id and kept of every row.

    Links join rows whose sets have a Jaccard similarity of ``threshold`` or more; ``n_links`` counts
    the other rows linked directly, copies included. ``class_id`` is the least doc_id of the rows with an
    equal set, ``component_id`` the least that links reach; one row of each component has ``kept``: the
    one with that id, the first of repeated rows. Words are runs of characters other than space and
    \\t\\n\\v\\f\\r, unchanged. A text of fewer than ``n`` words is one run; null texts and texts without
    words have no set, link with nothing and are kept. Null ids take part and come last in a component.
    An empty table gives an empty table. Other columns are not read. ``row`` numbers the rows. A task
    holds one text and its set, the sketches of two blocks of a bucket, or the sets of two blocks of a
    cluster: ``block`` sets of about ``block_bytes`` in all each, or one larger set.
    """
    levels = levels or levels_for(docs.count(), bucket)
    runs = runs_for(recall, threshold, branching, levels)
    sampler = Sampler(runs, levels, branching)

    def summarise(batches):
        for batch in pieces(batches, "text"):
            out = {"print": [], "size": [], "sketch": [], "paths": []}
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, n)
                out["print"].append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                out["size"].append(len(tokens))
                out["sketch"].append(sampler.sketch(tokens) if len(tokens) else None)
                out["paths"].append(sampler.paths(tokens) if len(tokens) else None)
            kinds = {"print": pa.binary(), "size": pa.int64(), "sketch": pa.binary(), "paths": pa.list_(pa.list_(pa.list_(pa.int64())))}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "key")), *(pa.array(out[c], t) for c, t in kinds.items())], ["row", "doc_id", "key", *kinds])

    rows = save(docs.select(*_keyed(id_col, text_col)).mapInArrow(summarise, "row long, doc_id long, key string, print binary, size long, sketch binary, paths array<array<array<long>>>"), "join-rows")
    classes = save(
        rows.where("print is not null").groupBy("print").agg(
            F.min("row").alias("rep"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("key").alias("key"),
            F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"),
        ),
        "join-classes",
    )

    # split by sampled tokens, level by level; only buckets above one block go on
    level = classes.select("rep", F.posexplode("paths").alias("run", "levels")).select("rep", "run", F.explode(F.col("levels")[0]).alias("token")).select("rep", "run", F.xxhash64("run", "token").alias("bucket"))
    final, done_with = None, []
    for depth in range(levels):
        sizes = level.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        known = save(level.join(sizes, "bucket"), f"join-level-{depth}")
        done_with.append(known)
        done = known if depth == levels - 1 else known.where(F.col("n") <= bucket)
        done = done.select("bucket", "rep", F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
        final = done if final is None else final.union(done)
        if depth < levels - 1:
            more = known.where(F.col("n") > bucket).join(classes.select("rep", "paths"), "rep")
            level = more.select("rep", "run", "bucket", F.explode(F.col("paths")[F.col("run")][depth + 1]).alias("token")).select("rep", "run", F.xxhash64("bucket", "token").alias("bucket")).distinct()
            level = save(level, f"join-paths-{depth + 1}")  # counted and joined below: split once
            done_with.append(level)

    # sketches in the buckets; small buckets share a task's call
    total = final.agg(F.sum("blocks")).first()[0] or 0
    slots = max(1, total // 8192)
    met = _dealt(final).join(classes.select("rep", "size", "sketch"), "rep").withColumn("slot", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(slots)))
    wanted = threshold + (1 - threshold) / 256
    enough = SKETCH * wanted - 4 * math.sqrt(SKETCH * wanted * (1 - wanted))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
        cells = np.stack([group.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
        key = np.concatenate([[0], np.cumsum((cells[1:] != cells[:-1]).any(1))]) if len(cells) else np.zeros(0)
        rep, size, own = (group.column(c).to_numpy() for c in ("rep", "size", "own"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        edges = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high - low > WALKED:
                at = np.arange(low, high)
                i, j = cells[low, 1:]
                a, b = walk(sketch, size, at[own[at] == i], None if i == j else at[own[at] == j], threshold, enough)
                links.append((rep[a], rep[b]))
                key[at] = -1 - at  # these are done: keys of their own meet nothing below
        for a, b in bucket_pairs(key):
            apart = (cells[a, 1] == cells[a, 2]) | (own[a] != own[b])  # in a pair of blocks: from one to the other
            near = apart & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
            a, b = a[near], b[near]
            near = (sketch[a] == sketch[b]).sum(1) >= enough
            links.append((rep[a[near]], rep[b[near]]))
            if sum(len(x) for x, _ in links) > 1 << 18:
                links = [forest(*(np.concatenate(x) for x in zip(*links, strict=True)))]
        a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True))) if links else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = met.groupBy("slot").applyInArrow(compare, "a long, b long")
    clusters = save(connected_components(edges, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "join-clusters")

    # exact sets, once for each pair of blocks of a cluster
    asked = clusters.join(classes.select("rep", "key", "copies"), "rep")
    once = docs.select(*_keyed(id_col, text_col)).select("key", "text").groupBy("key").agg(F.first("text").alias("text"))  # copies meet before the shuffle
    held = once.join(asked, "key").select("cluster", "rep", "copies", "text")

    def sets(batches):
        for batch in pieces(batches, "text"):
            found = [shingle_set(t, n).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "rep", "copies")), pa.array(found, pa.binary())], ["cluster", "rep", "copies", "tokens"])

    held = save(held.mapInArrow(sets, "cluster long, rep long, copies long, tokens binary"), "join-sets")
    slots = max(1, (held.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0) // (8 << 20))
    cells = _blocks(held, "cluster", block, F.octet_length("tokens"), block_bytes).withColumn("slot", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(slots))).otherwise(F.xxhash64("cluster", "i", "j")))

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        cell = np.stack([group.column(c).to_numpy() for c in ("cluster", "i", "j")], 1)
        edges = np.nonzero((cell[1:] != cell[:-1]).any(1))[0] + 1
        rep, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
        tokens = group.column("tokens")
        out: list[tuple[int, int | None, int]] = []
        for low, high in zip([0, *edges], [*edges, len(cell)], strict=True):
            mine = [np.frombuffer(t.as_buffer(), np.uint64) for t in tokens[int(low) : int(high)]]
            size = np.array([len(t) for t in mine], np.float64)
            i, j = cell[low, 1], cell[low, 2]
            left = np.nonzero(own[low:high] == i)[0]
            right = np.nonzero(own[low:high] == j)[0]
            if not len(left) or not len(right):
                continue
            ours = [mine[x] for x in left]
            common = overlaps(ours, ours if i == j else [mine[x] for x in right]).astype(np.float64)
            link = common >= threshold * (size[left][:, None] + size[right][None] - common) - 1e-9
            if i == j:
                np.fill_diagonal(link, False)
            weights = copies[low:high]
            counts = np.zeros(high - low, np.int64)
            np.add.at(counts, left, link @ weights[right])
            if i != j:
                np.add.at(counts, right, link.T @ weights[left])
            out += [(int(rep[low + x]), None, int(counts[x])) for x in np.nonzero(counts)[0]]
            x, y = np.nonzero(link)
            out += [(a, b, 0) for a, b in zip(*(e.tolist() for e in forest(rep[low + left[x]], rep[low + right[y]])), strict=True)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(c, pa.int64())})

    found = save(cells.drop("blocks").groupBy("slot").applyInArrow(verify, "a long, b long, n long"), "join-links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b"), "a", "b").select(F.col("node").alias("rep"), "component")
    facts = classes.select("print", "rep", "class_id", "copies").join(links, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = facts.groupBy("component").agg(F.min("class_id").alias("component_id"))
    facts = facts.join(least, "component").select("print", "component", "class_id", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    facts = save(facts, "join-facts")
    placed = rows.select("row", "doc_id", "key", "print").join(facts, "print", "left")
    first = placed.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")).select("component", F.col("first.row").alias("first"))
    out = placed.join(first, "component", "left").select(
        "row", "doc_id", "key", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"),
    )
    out = save(out, "join-result")
    for table in [*done_with, rows, classes, clusters, held, found, facts]:
        drop(table)
    return out


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each component of links, as ``join_documents`` marks it; rows with equal doc_id and text stay once.

    Of rows with equal doc_id and text the first in the order of all their columns stays. Rows whose
    text has no words have no set: they link with nothing and all stay as they are.
    """
    own = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("key", F.lit("null"))))
    kept = join_documents(docs, **settings).where("kept").select(own.alias("own")).distinct()
    wordless = ~F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    rest = F.struct(*(F.col(c) for c in docs.columns))
    rows = docs.select(rest.alias("rest"), F.col("doc_id"), F.md5(text_of()).alias("key"), wordless.alias("wordless"))
    alone = rows.where("wordless").select("rest.*")
    rows = rows.where(~F.col("wordless")).select("rest", own.alias("own"))
    return rows.join(kept, "own").groupBy("own").agg(F.min_by("rest", F.to_json("rest")).alias("rest")).select("rest.*").unionByName(alone)
