"""Packing of token ids into sequences: first-fit decreasing on a tournament tree of bin capacities.

Tokens: the tokenizer drops white space and never joins across it, so a text is cut at blanks and
each distinct chunk is encoded once per task, as far as a memo of bounded bytes holds it. A task holds
the ids of 4 MB of texts, or of one longer text. A document's ids are cut into
pieces of one sequence's length and a rest, while it is tokenized, so that only lengths need to be
packed: no ids cross the network.

Pieces are dealt into randomised groups by a hash, each group of about ``group_tokens`` tokens. In a
group the longest piece goes first, each into the first bin with room. The bins are the leaves of a
binary tree whose inner nodes hold the most room below, so the first fit is one walk down.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import decode, pieces, save, text_of

#: Closes every document.
END_ID = 2


class WordBpe:
    """Ids of texts by a ``tokenizers`` file, as the library gives them with add_special_tokens=False.

    A special token's string in a text is its id. The memo holds about ``limit`` bytes and what 4 MB of texts add.
    """

    #: Letters whose lower case and normal form are the same by any library, then marks that stand apart.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    #: Bytes of an entry of the memo besides its key and value.
    ENTRY = 200

    def __init__(self, path: str, limit: int = 256 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.known, self.held = limit, {"": b""}, 0
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _learn(self, chunks: set[str]) -> None:
        """Encode new chunks at once: each distinct word in lower case, and each run of marks."""
        if self.held > self.limit:
            self.known, self.held = {"": b""}, 0
        known = self.known
        split = {c: (m[1].lower(), m[2]) if (m := self.PLAIN.fullmatch(c)) else (c, "") for c in chunks - known.keys()}
        words = list({word for word, marks in split.values() if marks or self.PLAIN.fullmatch(word)} - known.keys())
        for at in range(0, len(words), 100):
            part = words[at : at + 100]
            self._keep(dict(zip(part, self._words(part), strict=True)))
        rest = list({x for parts in split.values() for x in parts if x} - known.keys())
        self._keep(dict(zip(rest, self._each(rest), strict=True)))
        self._keep({c: known[core] + known[marks] for c, (core, marks) in split.items() if c not in known})

    def _keep(self, new: dict[str, bytes]) -> None:
        self.known.update(new)
        self.held += self.ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of letters in one call: each ends with the first id that closes a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = [0, *(4 * np.nonzero(self.closes[ids])[0] + 4).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(cuts) == len(words) + 1 else self._each(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self._learn(set().union(*cut))
        known = self.known.__getitem__
        return [b"".join(map(known, chunks)) for chunks in cut]


def tokenize(docs: DataFrame, path: str, *, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, salt: a row per piece of at most ``length`` ids.

    Null and empty texts are one piece that holds the closing id alone. Repeated rows are documents of their own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = WordBpe(path), array("I", [END_ID]).tobytes(), 4 * length
        for batch in pieces(batches, "text"):
            out: list[tuple] = []
            encoded = words.encode([decode(t) for t in batch.column("text").to_pylist()])
            for doc, ids, row in zip(batch.column("doc_id").to_pylist(), encoded, batch.column("row").to_pylist(), strict=True):
                ids += end
                out += [(doc, at // 4, ids[at : at + step], len(ids) // 4, row) for at in range(0, len(ids), step)]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "start", "ids", "doc_tokens", "row"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, row long")


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each length and its place there; longest first, ties in the given order."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(parts: DataFrame, *, length: int = 4096, group_tokens: int = 1 << 22, seed: int = 17) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of at most ``length`` ids each.

    ``parts`` is read twice, so it should be a table: doc_id, start, length, row and more. Groups are
    dealt by a hash of row and start, where ``row`` tells apart rows with equal doc_id; a group has
    about ``group_tokens`` ids, so its size doesn't grow with the input. A sequence's id is its group's
    number times 2^32 plus its bin. An empty table gives an empty table.
    """
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    dealt = parts.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)))
    schema = parts.drop("row").schema.add("sequence_id", "long", False).add("offset", "long", False)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row", "ascending"), ("start", "ascending")])
        number = group.column("group")[0].as_py()
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), length)
        ids = pa.array([(number << 32) + b for b in bins], pa.int64())
        return group.drop_columns(["group", "row"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, *, length: int = 4096) -> DataFrame:
    """The pieces of all documents with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The checksums stand for the ids, which ``tokenize`` gives by (doc_id, start) for writing the
    sequences. See ``tokenize`` and ``pack`` for odd rows.
    """
    parts = tokenize(docs, path, length=length).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "row",
    )
    return pack(save(parts, "pack-parts"), length=length)
