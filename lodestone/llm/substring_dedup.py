"""Removal of repeated passages: exact counts of word windows by super-k-mers.

A window is ``k`` consecutive words of a document. Its minimiser is the run of ``m`` words in it with
the least hash, the leftmost of equals. Consecutive windows with the same minimiser make a
super-k-mer: one packed string of k - 1 words plus one for each window. Equal windows have equal
minimisers, so super-k-mers are dealt to buckets by their minimiser's hash, and each bucket sorts
them and counts their windows exactly, by their words. A string whose minimiser is alone in its bucket holds no
repeated window: two windows of one super-k-mer differ in where the minimiser stands.

A short line that stands in many documents would give each of them a string with the same minimiser.
So a first pass over all texts counts the distinct strings of each minimiser. Windows whose minimiser
has more than ``hot_strings`` travel one by one, as digests of 128 bits that are dealt by themselves:
what meets there are equal windows only.

Documents are dealt into chunks of about ``chunk_bytes``. A chunk sends each distinct string once and
says whether it has it more than once, so a passage that a third of all documents share reaches its
bucket once for each chunk, and the answers go to chunks, not documents. For each string with
repeated windows the chunk gets a bit mask; it then finds the strings in its documents again and
removes the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pieces, text_of

#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
#: Marks the keys of windows that travel alone; minimisers are below it.
ALONE = np.uint64(1 << 63)
RECORD = np.dtype([("hash", "<u8"), ("ordinal", "<u4"), ("size", "<u4"), ("windows", "u1"), ("many", "u1")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def split_words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, their number, and the hashes of all words in a row."""
    words = [t.split() if t else [] for t in texts]  # bytes.split() cuts at the six characters that are no part of words
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return words, sizes, np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words from ``start`` to before ``end``, the same wherever the run stands."""
    power = np.full(len(h) + 1, STEP)
    power[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * np.multiply.accumulate(power)[:-1])])
    power = np.full(len(h) + 1, BACK)
    power[0] = 1
    return _mixed((total[end] - total[start]) * np.multiply.accumulate(power)[start])


def super_kmers(h: np.ndarray, sizes: np.ndarray, k: int, m: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer of texts of ``sizes`` words.

    ``hot`` are sorted upper halves of minimisers that are too frequent: their windows are one string
    each, and have the key ALONE.
    """
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = h[: n - m + 1].copy()
    for i in range(1, m):
        value *= STEP
        value += h[i : n - m + 1 + i]
    value = _mixed(value) >> np.uint64(1)
    place, have = np.arange(n - m + 1, dtype=np.int32), 1
    while have < k - m + 1:
        by = min(have, k - m + 1 - have)
        later = value[by:] < value[:-by]
        place = np.where(later, place[by:], place[:-by])
        value = np.where(later, value[by:], value[:-by])
        have += by
    document = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inside = document[: n - k + 1] == document[k - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (document[1 : n - k + 1] != document[: n - k])
    if len(hot):
        first = np.nonzero(new)[0]  # windows up to the next of these have the same minimiser
        high = (value[first] >> np.uint64(32)).astype(np.uint32)
        often = hot[np.minimum(np.searchsorted(hot, high), len(hot) - 1)] == high
        alone = inside & np.repeat(np.append(False, often), np.diff(np.append(np.append(0, first), n - k + 1)))
        value[alone] = ALONE
        new |= alone
    starts = np.nonzero(new)[0]
    ends = np.nonzero(inside & np.append(~inside[1:] | new[1:], True))[0]
    return starts, ends - starts + 1, value[starts]


class Chunk:
    """The words of some documents, and their super-k-mers."""

    def __init__(self, texts: list[bytes | None], k: int, m: int, hot: np.ndarray):
        self.words, self.sizes, h = split_words(texts)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.k = k
        self.starts, self.counts, self.keys = super_kmers(h, self.sizes, k, m, hot)
        self.strings: dict[bytes, int] = {}
        self.ordinals = np.zeros(0, np.int64)
        if not len(self.starts):
            return
        del h
        joined = b" ".join([b" ".join(w) for w in self.words if w])
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, chain.from_iterable(self.words)), np.int64, int(self.sizes.sum())) + 1)])
        lows, highs = at[self.starts].tolist(), (at[self.starts + self.counts + k - 1] - 1).tolist()
        take = self.strings.setdefault
        alone = (self.keys == ALONE).tolist()
        cut = (xxhash.xxh3_128_digest(joined[a:b]) if one else joined[a:b] for a, b, one in zip(lows, highs, alone, strict=True))
        self.ordinals = np.fromiter((take(x, len(self.strings)) for x in cut), np.int64, len(lows))

    def blobs(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """Packed records and strings for each bucket."""
        if not len(self.starts):
            return
        _, one, often = np.unique(self.ordinals, return_index=True, return_counts=True)
        strings = list(self.strings)
        records = np.zeros(len(strings), RECORD)
        records["hash"], records["ordinal"] = self.keys[one], np.arange(len(strings))
        alone = np.nonzero(records["hash"] == ALONE)[0]
        records["hash"][alone] = ALONE | np.array([int.from_bytes(strings[i][:8], "little") for i in alone.tolist()], np.uint64)
        records["size"] = np.fromiter(map(len, strings), np.int64, len(strings))
        records["windows"], records["many"] = self.counts[one], often > 1
        bucket = (_mixed(records["hash"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pack = zstandard.ZstdCompressor(level=5).compress
        for part in np.split(order, np.nonzero(np.diff(bucket[order]))[0] + 1):
            body = b"".join([strings[i] for i in part.tolist()])
            yield int(bucket[part[0]]), pack(len(part).to_bytes(4, "little") + records[part].tobytes() + body)

    def removed(self, masks: np.ndarray) -> np.ndarray:
        """Which words a repeated window covers; ``masks`` has the bits of each string's windows."""
        flag = np.zeros(self.first[-1] + 1, np.int64)
        if len(self.starts):
            mask = masks[self.ordinals]
            for j in range(self.k):
                at = self.starts[(mask >> np.uint64(j)) & np.uint64(1) == 1] + j
                np.add.at(flag, at, 1)
                np.add.at(flag, at + self.k, -1)
        return np.cumsum(flag)[:-1] > 0


def _windows(string: bytes, k: int) -> Iterator[bytes]:
    """The windows of a packed string."""
    cuts = [-1, *np.nonzero(np.frombuffer(string, np.uint8) == 32)[0].tolist(), len(string)]
    return (string[cuts[j] + 1 : cuts[j + k]] for j in range(len(cuts) - k))


def repeated_windows(blobs: list[tuple[int, bytes]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """chunk, ordinals and masks of the strings of one bucket that have repeated windows.

    Strings are sorted by their minimisers; the windows of one minimiser are held at a time.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    tables, bodies, chunks = [], [], []
    for chunk, blob in blobs:
        raw = unpack(blob)
        n = int.from_bytes(raw[:4], "little")
        tables.append(np.frombuffer(raw, RECORD, n, 4).copy())
        bodies.append(raw[4 + n * RECORD.itemsize :])
        chunks.append(chunk)
    records = np.concatenate(tables)
    owner = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    low = np.concatenate([np.cumsum(t["size"], dtype=np.int64) - t["size"] for t in tables])
    del tables
    masks = np.zeros(len(records), np.uint64)
    full = lambda i: (1 << int(records["windows"][i])) - 1
    order = np.argsort(records["hash"], kind="stable")
    edges = np.nonzero(np.diff(records["hash"][order]))[0] + 1
    for i in np.nonzero(records["many"])[0].tolist():
        masks[i] = full(i)
    begin, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(order)]])
    for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        same: dict[bytes, list[int]] = {}
        for i in order[a:b].tolist():
            at = int(low[i])
            same.setdefault(bodies[owner[i]][at : at + int(records["size"][i])], []).append(i)
        if len(same) == 1:
            masks[order[a:b]] = full(order[a])
            continue
        alone = records["hash"][order[a]] >= ALONE
        often: dict[bytes, int] = {}
        for string, rows in same.items():
            weight = len(rows) + int(records["many"][rows].any())
            for w in [string] if alone else _windows(string, k):
                often[w] = often.get(w, 0) + weight
        for string, rows in same.items():
            masks[rows] |= np.uint64(sum(1 << j for j, w in enumerate([string] if alone else _windows(string, k)) if often[w] > 1))
    hit = np.nonzero(masks)[0]
    for o in np.unique(owner[hit]).tolist():
        mine = hit[owner[hit] == o]
        yield chunks[o], records["ordinal"][mine].astype(np.uint32), masks[mine]


def hot_minimisers(docs: DataFrame, k: int, m: int, hot_strings: int, *, most: int = 1 << 20, text_col: str = "text") -> np.ndarray:
    """Sorted upper halves of the minimisers with more than ``hot_strings`` strings, counted over all texts.

    A string counts once for each 4 MB of texts that hold it. The ``most`` most frequent ones at most;
    what lies beyond is dealt by its minimiser as ever.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            _, sizes, h = split_words(batch.column("text").to_pylist())
            starts, counts, keys = super_kmers(h, sizes, k, m, np.zeros(0, np.uint32))
            if len(starts):
                _, one = np.unique(span_hashes(h, starts, starts + counts + k - 1), return_index=True)
                high, n = np.unique((keys[one] >> np.uint64(32)).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(n.astype(np.int32))], ["high", "n"])

    counted = docs.select(text_of(text_col).alias("text")).where("text is not null").mapInArrow(run, "high int, n int")
    often = counted.groupBy("high").agg(F.sum("n").alias("n")).where(F.col("n") > hot_strings).orderBy(F.desc("n"), "high").limit(most)
    return np.sort(often.select("high").toArrow().column("high").to_numpy().astype(np.uint32))


def dedup_substrings(docs: DataFrame, *, k: int = 35, m: int = 5, chunk_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, hot_strings: int = 4096, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 bytes) and the columns in ``carry`` of every row.

    Removes each word covered by a window that also starts anywhere else, in this or another row;
    the kept words are joined by one space. Null and empty texts have no words; texts of fewer than
    ``k`` words lose none. A row that is repeated is a copy like any other, so it loses all its windows.
    Null ids are kept. An empty table gives an empty table. Other columns are not read; a carried column
    with the name of one of the first four is refused.

    ``k`` - ``m`` is at most 62, the bits of a mask. Chunks and buckets are counted from the bytes of all
    texts, so their sizes stay the same at any input size. The texts are read twice and shuffled once,
    packed strings of about 3.1 times their size, compressed, once. A task holds the words of a chunk or
    of one longer text, or the strings of a bucket.
    """
    if not 0 < m <= k or k - m > 62:
        raise ValueError("a super-k-mer needs 0 < m <= k and k - m <= 62")
    if clash := {"doc_id", "n_words", "n_removed", "kept"}.intersection(c.lower() for c in carry):
        raise ValueError(f"carried columns clash with the result: {sorted(clash)}")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, 3 * total // bucket_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(hot_minimisers(docs, k, m, hot_strings, text_col=text_col))
    # the text travels once, also where it is carried
    names = ["text" if c == text_col else f"carried_{i}" for i, c in enumerate(carry)]
    rows = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
        *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True) if n != "text"),
    )

    def ordered(table: pa.Table) -> pa.Table:
        # rows arrive in any order; equal (doc_id, text) need none
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def split(table: pa.Table) -> pa.Table:
        own = Chunk(ordered(table).column("text").to_pylist(), k, m, shared.value)
        found = list(own.blobs(buckets))
        number = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in found], pa.int64()), "chunk": pa.array([number] * len(found), pa.int64()), "blob": pa.array([x for _, x in found], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        found = list(repeated_windows(list(zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist(), strict=True)), k))
        return pa.table({"chunk": pa.array([c for c, _, _ in found], pa.int64()), "ordinals": pa.array([o.tobytes() for _, o, _ in found], pa.binary()), "masks": pa.array([x.tobytes() for _, _, x in found], pa.binary())})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        if table.num_rows:
            own = Chunk(table.column("text").to_pylist(), k, m, shared.value)
            masks = np.zeros(len(own.strings), np.uint64)
            own.strings.clear()
            for o, x in zip(answers.column("ordinals").to_pylist(), answers.column("masks").to_pylist(), strict=True):
                masks[np.frombuffer(o, np.uint32)] = np.frombuffer(x, np.uint64)
            gone = own.removed(masks)
            for words, a, b in zip(own.words, own.first[:-1].tolist(), own.first[1:].tolist(), strict=True):
                flags = gone[a:b]
                lost = int(flags.sum())
                out["n_words"].append(b - a)
                out["n_removed"].append(lost)
                out["kept"].append(b" ".join([words[i] for i in np.nonzero(~flags)[0].tolist()] if lost else words))
        made = {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.binary())}
        return pa.table({"doc_id": table.column("doc_id"), **made, **{n: table.column(n) for n in names}})

    strings = rows.groupBy("chunk").applyInArrow(split, "bucket long, chunk long, blob binary")
    answers = strings.groupBy("bucket").applyInArrow(count, "chunk long, ordinals binary, masks binary")
    kinds = dict(rows.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept binary" + "".join(f", {n} {kinds[n]}" for n in names)
    done = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, schema)
    back = lambda n: F.col(n).cast("string") if n == "text" else F.col(n)
    return done.select("doc_id", "n_words", "n_removed", "kept", *(back(n).alias(c) for c, n in zip(carry, names, strict=True)))
