"""The tagging stream: every micro-batch goes to tagged, quarantine and discovery tables, each written once.

A batch is written to folders named by its number, replaced if the batch runs again, so a restart
after a crash between the three writes leaves the same rows. The index is read anew for each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identity import DEFAULT_TAGS, IdentityTags
from ..functions.strictjson import Limits
from ..operators.classify import classify, oversized, quarantine, tag_headers, with_identity


def write_batch(records: DataFrame, batch: int, index: DataFrame, out: str, limits: Limits = Limits(), tags: IdentityTags = DEFAULT_TAGS, max_message_bytes: int = 1 << 20) -> None:
    """Records are classified once, into a folder of their own that the three tables are written from; it goes afterwards."""
    spark = records.sparkSession
    staged = f"{out}/_staged/batch={batch}"
    done = classify(with_identity(records, limits=limits, tags=tags), index)
    done.write.mode("overwrite").parquet(staged)
    done = spark.read.schema(done.schema).parquet(staged)
    origin = F.concat_ws("/", "topic", "partition", "offset")
    tag = F.coalesce("schema_id", "candidate", F.col("fate"))
    over = oversized(max_message_bytes)
    fine = done.where((F.col("fate") != "malformed") & ~over).withColumn("headers", tag_headers(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), tag, origin, tags))
    columns = ["key", "value", "headers", "topic", "partition", "offset", "source", "fate"]
    for name, rows in (
        ("tagged", fine.select(*columns, tag.alias("tag"))),
        ("quarantine", quarantine(done, max_message_bytes).select("key", "value", "reason", "topic", "partition", "offset", "source")),
        ("discovery", fine.where("fate = 'provisional'").select("key", "value", "candidate", "fp", "bucket", "source", "topic", "partition", "offset")),
    ):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def start(spark: SparkSession, records: DataFrame, index: Callable[[], DataFrame], out: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs over what there is and stops; restarted from the checkpoint it goes on."""
    run = lambda rows, batch: write_batch(rows, batch, index(), out, **options)
    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")
