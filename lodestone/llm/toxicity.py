"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, of words that begin with a lexicon stem and of
disguised lexicon words; how many of them stand near a second-person word; rates of capitals,
punctuation, exclamation marks, digits and disguised words; and size. The lexicon is induced from
labelled texts: words and stems that are much more frequent in toxic documents.

Training takes a bounded sample of labelled rows that are not held out: lexicon and trees come from
three quarters of it, the calibration from the rest. Every text is then scored whole, in one pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.boosting import Boosted, Isotonic, sigmoid
from lodestone.llm.common import decode, drop, pieces, save, text_of

#: Words of the second person in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs that stand for letters in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"})
LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: Words within this distance are near.
NEAR = 5
COLUMNS = ("size", "upper", "letters", "digits", "marks", "exclaims", "word", "stem", "masked", "disguised", "second", "mixed")


def terms(text: str) -> set[str]:
    """The distinct lower-case words, and stems as ``abcd*``."""
    found = set(LETTERS.findall(text.lower()))
    return found | {f"{w[:n]}*" for w in found if len(w) > 3 for n in STEMS if len(w) >= n}


def choose_lexicon(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, *, most: int = 400, support: int = 4, precision: float = 0.8) -> dict[str, float]:
    """Terms whose share of toxic documents is high, by the z-score of the difference of their rates."""
    scored = []
    for term, t, c in counts:
        rate = t / max(toxic, 1)
        other = c / max(clean, 1)
        if t >= support and rate / (rate + other) >= precision:
            z = (rate - other) / math.sqrt((t + c + 1) / (toxic + clean))
            scored.append((-z, term, (t + 0.5) / (t + c + 1)))
    return {term: weight for _, term, weight in sorted(scored)[:most]}


class Features:
    """Dense features of texts; what a token adds is kept in a table, as tokens repeat."""

    NAMES = 14

    def __init__(self, lexicon: dict[str, float], limit: int = 300_000):
        self.words = frozenset(t for t in lexicon if not t.endswith("*"))
        self.stems = frozenset(t[:-1] for t in lexicon if t.endswith("*"))
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.table = np.zeros((1024, len(COLUMNS)), dtype=np.float32)

    def _listed(self, word: str) -> tuple[bool, bool]:
        return word in self.words, any(word[:n] in self.stems for n in STEMS)

    def _token(self, token: str) -> int:
        low = token.lower()
        parts = LETTERS.findall(low)
        word = stem = masked = disguised = 0
        for p in parts:
            a, b = self._listed(p)
            word, stem = word or a, stem or b
        core = low.strip(".,;:!?\"'()[]{}<>*#%&")
        plain = core.translate(DISGUISES)
        mixed = core != "" and any(c.isalpha() for c in core) and not core.isalpha() and "'" not in core and "-" not in core
        if mixed:
            folded = "".join(c for c in plain if c.isalpha())
            a, b = self._listed(folded)
            masked = (a or b) and not (word or stem)
            disguised = plain != core
        letters = sum(map(str.isalpha, token))
        digits = sum(map(str.isdigit, token))
        row = (len(token), sum(map(str.isupper, token)), letters, digits, len(token) - letters - digits, token.count("!"), word, stem, masked, disguised, bool(SECOND_PERSON.intersection(parts)), mixed)
        at = len(self.seen)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = row
        self.seen[token] = at
        return at

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        out = np.zeros(self.NAMES)
        if not tokens:
            return out
        if len(self.seen) > self.limit:
            self._clear()
        get, new = self.seen.get, self._token
        at = np.fromiter((i if (i := get(t)) is not None else new(t) for t in tokens), np.int64, len(tokens))
        each = self.table[at]
        total = each.sum(0, dtype=np.float64)
        n, chars = len(tokens), total[0]
        listed = np.nonzero(each[:, 6] + each[:, 7] + each[:, 8])[0]
        second = np.nonzero(each[:, 10])[0]
        near = 0
        if len(listed) and len(second):
            k = np.searchsorted(second, listed - NEAR)
            near = int((second[np.minimum(k, len(second) - 1)] <= listed + NEAR)[k < len(second)].sum())
        out[:] = (
            100 * total[6] / n, 100 * total[7] / n, 100 * total[8] / n, math.log1p(total[6]), math.log1p(total[7]), math.log1p(len(set(at[listed].tolist()))), 100 * near / n,
            total[1] / max(total[2], 1), total[4] / chars, 100 * total[5] / chars, total[3] / chars, 100 * total[9] / n, 100 * total[11] / n, math.log(n),
        )
        return out

    def matrix(self, texts: Iterable[str]) -> np.ndarray:
        found = [self.of(t) for t in texts]
        return np.array(found) if found else np.zeros((0, self.NAMES))


class Scorer:
    """Features, trees and calibration. A sample without both labels gives its share of ones to every text."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, apart: np.ndarray):
        self.lexicon = lexicon
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < y[~apart].sum() < (~apart).sum() and 0 < y[apart].sum() < apart.sum():
            self.trees = Boosted(x[~apart], y[~apart])
            self.calibrated = Isotonic(self.trees.raw(x[apart]), y[apart])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        return 0.99 * self.calibrated(raw) + 0.01 * sigmoid(raw)  # the last hundredth keeps the order within a step


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled rows, those with the smallest hashes of their ids.

    A doc_id that is labelled twice counts as its largest label; one that stands twice in ``docs`` is taken once.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(rows)
    )
    found = docs.join(F.broadcast(chosen), "doc_id")  # ``rows`` rows at most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, sample_rows: int = 8000) -> Scorer:
    """Fit on at most ``sample_rows`` labelled rows where ``allowed``, a condition on doc_id."""
    apart = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(4)) == 0
    sample = save(labelled_sample(docs.select(F.col("doc_id"), text_of().alias("text")), labels, label, allowed, sample_rows).withColumn("apart", apart), "toxic-sample")

    def count(batches):
        for batch in pieces(batches, "text"):
            toxic: dict[str, int] = {}
            clean: dict[str, int] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                into = toxic if y else clean
                for t in terms(decode(text)):
                    into[t] = into.get(t, 0) + 1
            names = [*toxic, *(t for t in clean if t not in toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic.get(t, 0) for t in names], pa.int64()), pa.array([clean.get(t, 0) for t in names], pa.int64())], ["term", "toxic", "clean"])

    fitting = sample.where(~F.col("apart"))
    sizes = {r["label"]: r["n"] for r in fitting.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counted = fitting.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    frequent = counted.where((F.col("toxic") >= 4) & (F.col("toxic") * F.lit(max(1, sizes.get(0, 1))) >= 4 * F.col("clean") * F.lit(max(1, sizes.get(1, 1)))))
    lexicon = choose_lexicon(((r["term"], r["toxic"], r["clean"]) for r in frequent.toLocalIterator()), sizes.get(1, 0), sizes.get(0, 0))

    def featurize(batches):
        features = Features(lexicon)
        for batch in pieces(batches, "text"):
            x = features.matrix(decode(t) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "apart")), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "apart", "x"])

    rows = sample.select("text", "doc_id", "label", "apart").mapInArrow(featurize, "doc_id long, label int, apart boolean, x array<double>").orderBy("doc_id").toArrow()
    drop(sample)
    x = np.array(rows.column("x").to_pylist()).reshape(-1, Features.NAMES)
    return Scorer(lexicon, x, rows.column("label").to_numpy().astype(float), rows.column("apart").to_numpy().astype(bool))


def score_documents(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, sample_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row's whole text.

    Rows whose crc32 of doc_id is a multiple of ``folds`` are held out: their labels are never read.
    Null and empty texts have features of zero and get the score that these get; a null doc_id is not
    held out and never labelled. Repeated rows come out repeated, an empty table empty. Only doc_id and
    text are read, and only text is scored.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
    scorer = train(docs, labels, label, ~held, sample_rows=sample_rows)
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.value.lexicon)
        for batch in pieces(batches, "text"):
            score = model.value.score(features.matrix(decode(t) for t in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
