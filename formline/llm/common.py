"""What the operators share: tables in the cluster's shared folder, text helpers, bounded batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

#: White space of the word rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="formline-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Workspace:
    """Written tables of one run of an operator, which cut lineage and outlive executors.

    Each ``save`` gets a folder of its own, so that a retried run never reads another's files;
    ``drop`` removes a table that nothing reads any longer.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/formline-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._formline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._formline_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def bounded(batches: Iterable[pd.DataFrame], column: str = "text", chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cuts Arrow batches so that none holds more than ``chars`` characters, but for a longer single text."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[column].str.len().fillna(0).to_numpy(dtype=np.int64).cumsum()
        start = 0
        while start < len(pdf):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + chars, side="right")))
            yield pdf.iloc[start:end]
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def not_held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds != held


def least_hashed(rows: DataFrame, label: str, n: int) -> DataFrame:
    """At most ``n`` of the distinct rows of each label, those whose ``doc_id`` hashes lowest.

    Rows are counted by label first, and only those below a hash that about twice as many fall short of
    go on, so no task sees a label's rows, however many it has. Ties go to the lesser ``doc_id``.
    """
    top = 1 << 62
    place = F.pmod(F.xxhash64("doc_id"), F.lit(top))
    counts = rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))  # a row for each label
    few = rows.join(F.broadcast(counts), F.col(label) == F.col("__label")).where(place <= F.least(F.lit(1.0), F.lit(2.0 * (n + 32)) / F.col("__n")) * float(top))
    order = W.partitionBy(label).orderBy(place, "doc_id")
    return few.select(*rows.columns).distinct().withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")
