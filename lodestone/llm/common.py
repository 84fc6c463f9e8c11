"""What the operators share: scratch tables in the cluster's shared folder, and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: in local mode one of our own, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    The plan above starts from files that any executor can read, so a lost executor costs no more
    than the tasks it ran, and nothing below is computed twice.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    if (made := _made.get()) is not None:
        made.append(found)
    return found


#: Tables that ``save`` wrote inside ``tidy``.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def tidy(keep: list[DataFrame]) -> Iterator[None]:
    """Delete the tables that are saved inside, but for those in ``keep`` at the end."""
    token = _made.set([])
    try:
        yield
    finally:
        for table in _made.get():
            if not any(table is k for k in keep):
                drop(table)
        _made.reset(token)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``save`` returned and that nothing needs any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(name).cast("binary")


def decode(value: bytes | None) -> str:
    """A text from its bytes; null is the empty text and stray bytes become U+FFFD."""
    return "" if value is None else value.decode("utf-8", "replace")


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
