"""Byte-level BPE by automaton: encode and decode with the ranks of a public vocabulary.

A word's bytes become a Latin-1 string, so that the automaton's letters are bytes. At each place the
automaton's trie tells how far a match can reach. From the left, the longest match is taken if it is
compatible with the token before it: two tokens are compatible if merging their joined
bytes from scratch gives back exactly these two, which is remembered for each pair. If no match
fits, the last token gives way to the next shorter one at its place; places from which the end
cannot be reached are marked and not entered again, so each place is expanded once. A sequence
whose neighbours are all compatible is the one that the merges by rank produce.

Words repeat, so each word is encoded once per task, in a memo of bounded bytes. A task holds the ids
of 4 MB of texts, or of one longer text.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from sys import getsizeof

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import decode, pieces, text_of

#: White space as the pattern of the ranks has it: Python's also holds these four.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Cuts only where the pattern of the ranks cuts as well; what it yields is cut by that pattern in turn.
#: The first branch, letters up to a mark that is no letter, only saves entries of the memo.
COARSE = re.compile(rf" ?[A-Za-zÀ-ÖØ-öø-ʯ]+(?=[ \n.,;:!?])| ?{OTHER}+|{SPACE}+(?!{OTHER})|{SPACE}+")


class Memo(dict):
    """Results by word, in two generations of about ``limit`` bytes each; words of over 64 kB aren't kept."""

    def __init__(self, make, limit: int = 32 << 20):
        super().__init__()
        self.make, self.limit, self.old, self.held = make, limit, {}, 0

    def __missing__(self, key):
        if len(key) > 1 << 16:
            return self.make(key)
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        self.held += 100 + getsizeof(key) + getsizeof(found)
        return found


class ByteBpe:
    """The tokenizer of one rank file; ``pattern`` cuts a text into the words that are merged on their own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.table[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks), default=1)
        self.fits: dict[int, bool] = {}
        self.memo = Memo(self._chunk)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """By the definition: merge the neighbours of the lowest rank, leftmost first, until none has one."""
        rank_of, never = self.ranks.get, 1 << 60
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [rank_of(word[i : i + 2], never) for i in range(len(word) - 1)]
        while ranks and (rank := min(ranks)) < never:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], never)
        return [self.ranks[x] for x in parts]

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``, remembered; left -1 is the start of a word."""
        key = (left + 1) << 32 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            if left < 0:
                found = self.merge(self.table[right]) == [right]
            else:
                found = self.merge(self.table[left] + self.table[right]) == [left, right]
            self.fits[key] = found
        return found

    def word(self, word: bytes) -> list[int]:
        """The ids of one word in time linear in its length, as tokens are of bounded length."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        letters, size = word.decode("latin-1"), len(word)
        reach, rank_at, fits, most = self.automaton.longest_prefix, self.automaton.get, self.fits, self.longest
        path: list[int] = []
        at, length, before, dead = 0, reach(letters[:most]), -1, set()
        lengths = []  # of the token that was taken at each place of the path
        while at < size:
            while length:
                rank = rank_at(letters[at : at + length], None)
                if rank is not None and at + length not in dead:
                    fit = fits.get((before + 1) << 32 | rank)
                    if self.fit(before, rank) if fit is None else fit:
                        break
                length -= 1
            if length:
                path.append(rank)
                lengths.append(length)
                at, before = at + length, rank
                length = reach(letters[at : at + most])
                continue
            if not path:
                raise ValueError("the vocabulary lacks a single byte of this word")
            dead.add(at)
            length = lengths.pop()
            at -= length
            length -= 1
            path.pop()
            before = path[-1] if path else -1
        return path

    def _chunk(self, chunk: str) -> bytes:
        ids = array("I")
        for m in self.words.findall(chunk):
            ids.extend(self.word(m.encode()))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, COARSE.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary) and decoded (bytes) of every row's whole text.

    ``path`` is a file that every executor has. Null and empty texts have no ids. Rows are mapped one
    by one, with no shuffle: repeated rows come out repeated, an empty table empty; other columns are
    not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.from_file(path, pattern)
        for batch in pieces(batches, "text"):
            ids = [bpe.encode(decode(t)) for t in batch.column("text").to_pylist()]
            back = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``encode_documents`` returns."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
