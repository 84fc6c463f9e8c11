"""The stream summaries as Structured Streaming operators, with state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.scalars import PRIME, linear_hashes, trailing_zeros
from lodestone.operators.streams import BITS


def read_files(spark: SparkSession, folder: str, schema: str, *, files: int = 1) -> DataFrame:
    """A stream of parquet files, ``files`` for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling_count(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Rows and sum of ``value`` by event type and window of event time, with a watermark."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
        .groupBy(F.window(time, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )


def distinct_estimate(events: DataFrame, user: str = "user_id", length: str = "1 hour", late: str = "10 minutes", hashes: int = 50, modulus: int = 997, time: str = "ts") -> DataFrame:
    """start, estimate of the distinct users in each window of event time, by Flajolet and Martin (M9).

    The estimate is the mean over the hashes of 2^R, R the most trailing zeros, rounded down. State is one
    number for each hash and open window, whatever the users; null users are not counted. All is built in.
    """
    zeros = [trailing_zeros(F.pmod(F.pmod(F.col(user) * a + b, F.lit(PRIME)), F.lit(modulus))) for a, b in linear_hashes(hashes, modulus)]
    rows = events.where(F.col(user).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    most = rows.groupBy(F.window(time, length)).agg(*(F.max(z).alias(f"r{j}") for j, z in enumerate(zeros)))
    total = F.aggregate(F.array(*(F.pow(F.lit(2.0), f"r{j}") for j in range(hashes))), F.lit(0.0), lambda a, x: a + x)
    return most.select(F.col("window.start").alias("start"), F.floor(total / hashes).cast("long").alias("estimate"))


def bloom(events: DataFrame, user: str = "user_id", shards: int = 8, hashes: int = 50, bits: int = BITS) -> DataFrame:
    """shard, unseen, false_positives of each micro-batch: a Bloom filter for each hash shard of the users.

    The bits and the users seen so far stay in the state store, so the filter outlives a restart.
    """
    made = linear_hashes(hashes, bits)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        field, seen = state.get if state.exists else (b"", [])
        field = bytearray(field) or bytearray(-(-bits // 8))
        known = set(seen)
        unseen = false = 0
        for frame in frames:
            for x in frame[user].tolist():
                places = [(a * x + b) % PRIME % bits for a, b in made]
                if x not in known:
                    unseen += 1
                    false += all(field[p >> 3] >> (p & 7) & 1 for p in places)
                    known.add(x)
                for p in places:
                    field[p >> 3] |= 1 << (p & 7)
        state.update((bytes(field), sorted(known)))
        yield pd.DataFrame({"shard": [key[0]], "unseen": [unseen], "false_positives": [false]})

    keyed = events.where(F.col(user).isNotNull()).withColumn("shard", F.pmod(F.xxhash64(user), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandasWithState(run, "shard int, unseen long, false_positives long", "field binary, seen array<long>", "append", GroupStateTimeout.NoTimeout)


def reservoir(events: DataFrame, user: str = "user_id", size: int = 100, shards: int = 1) -> DataFrame:
    """shard, seen, sample after each micro-batch: a reservoir for each shard, acceptance by arithmetic hashes."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, sample = state.get if state.exists else (0, [])
        sample = list(sample)
        for frame in frames:
            for x in frame[user].tolist():
                n += 1
                if n <= size:
                    sample.append(x)
                elif (n * 48271 + 11) % 1000003 / 1000003.0 < size / n:
                    sample[(n * 69621 + 7) % size] = x
        state.update((n, sample))
        yield pd.DataFrame({"shard": [key[0]], "seen": [n], "sample": [sample]})

    keyed = events.where(F.col(user).isNotNull()).withColumn("shard", F.pmod(F.xxhash64(user), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInPandasWithState(run, "shard int, seen long, sample array<long>", "n long, sample array<long>", "append", GroupStateTimeout.NoTimeout)
