"""Quality scores by co-training of a text view and a metadata view.

The text view is boosted trees on measures of the text: word and line repetition, symbols, capitals,
digits, lengths. The metadata view is a logistic regression on the source, the language and the
recorded size. Each starts from the labelled sample. In each round each view scores a pool of
unlabelled rows and hands its surest ones, as many of either class as the labels suggest, to the
other's training set. Both are then calibrated on labelled rows that took no part, a last regression
on the calibrated log odds weighs the views, and every row is scored from its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.boosting import Boosted, Isotonic, Logistic, sigmoid
from lodestone.llm.common import decode, drop, pieces, save, text_of

SIGNS = np.array([ord(c) for c in "*$%&#!|<>{}[]=_~^\\/@+"], np.int64)
SOURCES, LANGS, SIZES = 64, 16, 12
TEXT_SIZE = 18


def text_measures(raw: bytes | None) -> list[float]:
    """Measures of a text; all zero for a null or empty one."""
    text = decode(raw)
    words = text.split()
    if not words:
        return [0.0] * TEXT_SIZE
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    longest = max(map(len, words))
    lengths = len(text) - count[32] - count[10]
    return [
        math.log(n), math.log1p(len(lines)), lengths / n, math.log(longest), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)),
        upper / max(1, upper + lower), digits / size, count[SIGNS].sum() / size, count[33] / size, count[124] / size, (count[46] + count[44]) / size, count[128:].sum() / size,
        count[10] / size, (count[60] + count[62] + count[123] + count[125]) / size, (count[42] + count[36] + count[37] + count[38] + count[35]) / n, math.log1p(len(set(words))),
    ]


def metadata_measures(source: int, lang: int, n_chars: float | None) -> list[int]:
    """Places of the ones in the metadata vector: hashed source, hashed language, size step."""
    step = 0 if n_chars is None or n_chars <= 0 else 1 + min(SIZES - 2, int(math.log2(n_chars + 1) / 1.6))
    return [source % SOURCES, SOURCES + lang % LANGS, SOURCES + LANGS + step]


def _wide(places: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(places), SOURCES + LANGS + SIZES))
    for i, own in enumerate(places):
        x[i, own] = 1
    return x


class CoTrained:
    """Two views that have taught each other. Without both labels, every row gets the share of ones."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, apart: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, *, rounds: int = 4, sure: float = 0.95, per_round: int = 200):
        self.share = float(y.mean()) if len(y) else 1.0
        self.text = None
        mine = ~apart
        if not (0 < y[mine].sum() < mine.sum() and 0 < y[apart].sum() < apart.sum()):
            return
        x, z, t = text[mine], meta[mine], y[mine]
        given: dict[str, dict[int, float]] = {"text": {}, "meta": {}}  # pool row -> label that the other view gave
        low = 1 - self.share

        def fit(kind):
            rows = np.array(sorted(given[kind]), dtype=int)
            labels = np.array([given[kind][r] for r in rows.tolist()])
            weight = np.concatenate([np.ones(len(t)), np.full(len(rows), 0.3)])
            if kind == "text":
                return Boosted(np.concatenate([x, pool_text[rows]]), np.concatenate([t, labels]), trees=60, weight=weight)
            return Logistic(np.concatenate([z, pool_meta[rows]]), np.concatenate([t, labels]), weight=weight)

        views = {k: fit(k) for k in given}
        for _ in range(rounds if len(pool_text) else 0):
            for kind, other, pool in (("text", "meta", pool_text), ("meta", "text", pool_meta)):
                p = sigmoid(views[kind].raw(pool))
                order = np.argsort(p, kind="stable")
                zeros, ones = max(1, round(per_round * low)), max(1, round(per_round * self.share))
                new = [(int(i), 0.0) for i in order if p[i] <= 1 - sure and int(i) not in given[other]][:zeros]
                new += [(int(i), 1.0) for i in order[::-1] if p[i] >= sure and int(i) not in given[other]][:ones]
                given[other].update(new)
            views = {k: fit(k) for k in given}
        self.given = {k: len(v) for k, v in given.items()}
        self.text, self.meta = views["text"], views["meta"]
        a, b = self.text.raw(text[apart]), self.meta.raw(meta[apart])
        self.steps = Isotonic(a, y[apart]), Isotonic(b, y[apart])
        self.both = Logistic(self._odds(a, b), y[apart])

    def _odds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = np.clip(np.stack([self.steps[0](a), self.steps[1](b)], 1), 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), self.share)
        return sigmoid(self.both.raw(self._odds(self.text.raw(text), self.meta.raw(meta))))


def _measures(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text, the hashed metadata and more; a null source or language is a value of its own."""

    def code(name, n):
        return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\x00"))), F.lit(n)).cast("int").alias(name)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), code("source", SOURCES), code("lang", LANGS), F.col("n_chars").cast("double"), *more)


def _vectors(batch: pa.RecordBatch) -> tuple[list[list[float]], list[list[int]]]:
    text = [text_measures(t) for t in batch.column("text").to_pylist()]
    meta = [metadata_measures(*m) for m in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
    return text, meta


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", labelled_rows: int = 6000, pool_rows: int = 6000) -> CoTrained:
    """Fit on at most ``labelled_rows`` labelled rows and ``pool_rows`` others, by the smallest hashes of their ids."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = F.xxhash64(F.lit(37), "doc_id")
    chosen = marks.orderBy(order, "doc_id").limit(labelled_rows)
    others = docs.select(F.col("doc_id").cast("long")).where("doc_id is not null").join(marks, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(pool_rows)
    wanted = chosen.unionByName(others.withColumn("label", F.lit(None).cast("int")))

    def run(batches):
        for batch in pieces(batches, "text"):
            text, meta = _vectors(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(text, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "label", "text", "meta"])

    wanted = save(wanted, "quality-sample")
    rows = _measures(docs).join(F.broadcast(wanted), "doc_id")  # labelled_rows + pool_rows at most
    found = rows.select("doc_id", "label", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, label int, text array<double>, meta array<int>")
    found = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct("text", "meta")).alias("one")).select("doc_id", "label", "one.text", "one.meta").orderBy("doc_id")  # of a repeated doc_id one row
    table = found.withColumn("apart", F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(4)) == 0).toArrow()
    drop(wanted)
    text = np.array(table.column("text").to_pylist()).reshape(-1, TEXT_SIZE)
    meta = _wide(table.column("meta").to_pylist())
    y = np.array([np.nan if v is None else v for v in table.column("label").to_pylist()], dtype=float)
    apart = table.column("apart").to_numpy().astype(bool)
    known = ~np.isnan(y)
    return CoTrained(text[known], meta[known], y[known], apart[known], text[~known], meta[~known])


def score_documents(docs: DataFrame, labels: DataFrame, *, carry: tuple[str, ...] = (), threshold: float = 0.5, **sample) -> DataFrame:
    """doc_id, score (0 to 1, higher is better), accepted and the columns in ``carry`` of every row.

    A null or empty text has measures of zero. Rows with a null doc_id are scored, but never train.
    Repeated rows come out repeated, an empty table empty; with no labels the score is 1. Reads doc_id,
    text, source, lang and n_chars.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **sample))
    names = [f"carried_{i}" for i in range(len(carry))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            text, meta = _vectors(batch)
            score = model.value.score(np.array(text).reshape(-1, TEXT_SIZE), _wide(meta))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), *(batch.column(n) for n in names)], ["doc_id", "score", *names])

    rows = _measures(docs, *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    kinds = dict(rows.dtypes)
    scored = rows.mapInArrow(run, "doc_id long, score double" + "".join(f", {n} {kinds[n]}" for n in names))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("accepted"), *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)))
