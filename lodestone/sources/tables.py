"""Sources and sinks: parquet, CSV, JSON lines, text, checkpoints and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scalars import short_year


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (S12); Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``; in local mode one of our own where that is unset."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a parquet table, which takes a part of a checkpoint's disk but forgets how rows were dealt."""
    path = f"{_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema (S1, S2, S7): no pass over the data to infer one."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, header: bool = True, quote: str = '"') -> DataFrame:
    """CSV with a given schema, quotes respected."""
    return spark.read.schema(schema).csv(path, header=header, quote=quote, escape=quote)


def read_points(spark: SparkSession, path: str, size: int) -> DataFrame:
    """id, label, features of a headerless CSV of numbers."""
    names = [f"f{i}" for i in range(size)]
    rows = read_csv(spark, path, "id long, label double, " + ", ".join(f"{n} double" for n in names), header=False)
    return rows.select("id", "label", F.array(*names).alias("features"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """key, product_id of quoted retail rows: the date with a short year and the customer without leading zeros make the key."""
    schema = "day string, customer string, a string, b string, c string, product string"
    return read_csv(spark, path, schema).select(F.concat_ws("-", short_year(F.trim("day")), F.expr("try_cast(customer AS bigint)").cast("string")).alias("key"), F.expr("try_cast(product AS bigint)").alias("product_id"))


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A local collection as a table."""
    return spark.createDataFrame(rows, schema)


def load_model(kind: type[MLReadable], path: str):
    """A fitted model from its folder."""
    return kind.load(path)


def save_model(model, path: str) -> None:
    """A fitted model to a folder (K8)."""
    model.write().overwrite().save(path)


def answers(df: DataFrame) -> DataFrame:
    """One JSON document of a row of named answers (K1)."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Headered CSV (K2, K7); one file only for small reports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)


def write_text(df: DataFrame, path: str) -> None:
    """Lines of the column ``value`` (K9)."""
    df.coalesce(1).write.mode("overwrite").text(path)


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """A line for each size, its itemsets in order as ('a', 'b') (K3)."""
    quoted = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    lines = itemsets.groupBy("size").agg(F.array_join(F.array_sort(F.collect_list(quoted)), ",").alias("value"))
    return lines.orderBy("size").select("value")


def candidate_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Both tables of itemsets under their headings, with an empty line after each size (K3).

    The order is part of the report: the section, the size, the line. No itemsets leave the heading alone.
    """
    spark = candidates.sparkSession
    parts = None
    for section, (heading, itemsets) in enumerate([("Candidates:", candidates), ("Frequent Itemsets:", frequent)]):
        quoted = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
        lines = itemsets.groupBy("size").agg(F.array_join(F.array_sort(F.collect_list(quoted)), ",").alias("value"))
        lines = lines.select(F.lit(section).alias("section"), "size", F.posexplode(F.array("value", F.lit(""))).alias("line", "value"))
        top = spark.range(1).select(F.lit(section).alias("section"), F.lit(0).alias("size"), F.lit(0).alias("line"), F.lit(heading).alias("value"))
        both = top.unionByName(lines)
        parts = both if parts is None else parts.unionByName(both)
    return parts.orderBy("section", "size", "line").select("value")


def community_report(communities: DataFrame) -> DataFrame:
    """One community a line, members quoted, by (size, first member) (K4)."""
    return communities.orderBy("size", F.col("members")[0]).select(F.concat(F.lit("'"), F.array_join(F.transform("members", lambda x: x.cast("string")), "', '"), F.lit("'")).alias("value"))


def betweenness_report(edges: DataFrame) -> DataFrame:
    """``('u', 'v'),value`` lines, largest first, values of 5 digits."""
    line = F.concat(F.lit("('"), F.col("src").cast("string"), F.lit("', '"), F.col("dst").cast("string"), F.lit("'),"), F.round("betweenness", 5).cast("string"))
    return edges.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("value"))
