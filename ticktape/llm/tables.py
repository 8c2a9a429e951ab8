"""Shared helpers: text columns, tables written to cut a plan, running totals without one big group."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape.streaming.workdir import new_folder, shared_folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers unless their path leads to it already.

    A job started with ``--py-files`` or from an installed package needs none of this.
    """
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if "site-packages" in root or any(os.path.isdir(os.path.join(p or ".", "ticktape", "llm")) for p in found):
        return
    if context.applicationId not in _SHIPPED:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "ticktape"), "zip", root, "ticktape")
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def text_of(column: str = "text") -> Column:
    """The whole text; a null is an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the plan and outlives any executor.

    For narrow tables that are read more than once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(hash: Column, sample: int, n: int) -> Column:
    """Whether a row is among about ``sample`` of ``n``, by a 64-bit hash; a share of any smallness is kept, so none rounds to 0."""
    return hash.bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(min(1 << 62, (sample << 62) // max(1, n)))


def looked_up(rows: DataFrame, side: DataFrame, key: str, busy: int = 1000) -> DataFrame:
    """``rows``, a written table, with the columns of ``side``, which has one row per key; null where it has none.

    A key with more than a ``busy``-th of the rows meets its row of ``side`` by a broadcast; there are fewer than ``busy`` such keys
    whatever the input.  The others are shuffled, and no key is then a large part of it.  Null keys match nothing and stay where they are.
    """
    known = rows.where(F.col(key).isNotNull())
    many = known.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * busy > known.count()).select(key)
    many = F.broadcast(written(many, "busy-keys"))
    there = known.join(many, key, "left_semi").join(F.broadcast(side.join(many, key, "left_semi")), key, "left")
    elsewhere = known.join(many, key, "left_anti").join(side, key, "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name != key]
    columns = [*rows.columns, *[c for c in side.columns if c != key]]
    lone = rows.where(F.col(key).isNull()).select("*", *nothing)
    return there.select(*columns).unionByName(elsewhere.select(*columns)).unionByName(lone.select(*columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


__all__ = ["documents", "labels", "looked_up", "new_folder", "pages", "sampled", "shared_folder", "ship", "text_of", "written"]
