"""Readers and writers of records in files, and a thin interface to message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A record as it comes from a stream.
RECORD = "key binary, value binary, headers array<struct<key:string,value:binary>>, topic string, partition int, offset bigint, source string"


def stream(spark: SparkSession, path: str, per_trigger: int = 500, format: str = "parquet") -> DataFrame:
    """Records of a folder as a stream. With a message broker's connector, ``broker`` gives the same columns."""
    return spark.readStream.format(format).schema(RECORD).option("maxFilesPerTrigger", per_trigger).load(path)


def broker(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 500) -> DataFrame:
    """Records of topics; needs the Kafka connector on the class path, and is not tested here."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        .option("includeHeaders", "true").option("kafka.isolation.level", "read_committed").option("maxOffsetsPerTrigger", per_trigger).load()
    )
    return raw.select("key", "value", "headers", "topic", "partition", "offset", F.col("topic").alias("source"))


def corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one per file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def archive(rows: DataFrame, at: str, path: str) -> None:
    """Compressed JSON lines by day; days that are written again are replaced."""
    dated = rows.withColumn("dt", F.date_format(at, "yyyy-MM-dd"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("dt").json(path)


def without_topics(rows: DataFrame, dropped: list[str]) -> DataFrame:
    """Rows of other topics than those that are not worth keeping."""
    return rows.where(~F.col("topic").isin(*dropped)) if dropped else rows


def prune(spark: SparkSession, path: str, today: str, keep_days: int = 365) -> list[str]:
    """Drops the days of an archive that are older than so many before ``today`` (yyyy-MM-dd), and names them; other folders stay."""
    from datetime import date, timedelta

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first, gone = date.fromisoformat(today) - timedelta(days=keep_days), []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        try:
            day = date.fromisoformat(name.removeprefix("dt=")) if name.startswith("dt=") else None
        except ValueError:
            day = None
        if day is not None and day < first:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix("dt="))
    return sorted(gone)


def snapshot(rows: DataFrame, key: str) -> DataFrame:
    """(split, n, digest) of rows with a split: the digest is over the rows' hashes in the order of the key.

    Rows are hashed where they are; only their digests are sorted and joined.
    """
    lines = rows.select("split", key, F.sha2(F.to_json(F.struct(*[c for c in sorted(rows.columns) if c != "split"])), 256).alias("h"))
    # Digests of slices first, so that no task joins the digests of all rows.
    sliced = lines.groupBy("split", F.substring("h", 1, 3).alias("slice")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return sliced.groupBy("split").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def metrics_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) of lines in the exposition format; comments and blank lines are none."""
    pattern = r'^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?$'
    pairs = F.regexp_extract_all(F.regexp_extract(column, pattern, 2), F.lit(r'(\w+="(?:[^"\\]|\\.)*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, r'="(.*)"$', 1))))
    found = lines.where(F.col(column).rlike(pattern) & ~F.col(column).startswith("#"))
    return found.select(F.regexp_extract(column, pattern, 1).alias("name"), labels.alias("labels"), F.regexp_extract(column, pattern, 3).try_cast("double").alias("value"))
