"""The consumer of the discovery table: unknown shapes into candidates, at least once and counted once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DISCOVERED = "key binary, value binary, candidate string, fp string, bucket string, source string, topic string, partition int, offset bigint"
BASE_MS, MOST_MS = 250, 10_000


def pause_ms(failures: int) -> int:
    """How long to wait after so many failures in a row."""
    return min(BASE_MS << min(failures, 20), MOST_MS)


def persistent(write: Callable[[], None], tries: int = 8, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a write until it goes through, with growing pauses; the last failure is raised. Returns how often it failed."""
    for failed in range(tries):
        try:
            write()
            return failed
        except Exception:
            if failed + 1 == tries:
                raise
            sleep(pause_ms(failed) / 1000)
    return tries


def absorb(rows: DataFrame, batch: int, out: str) -> None:
    """A batch's counts by candidate, in a folder that a rerun replaces; records without a candidate or a source are skipped."""
    fine = rows.where("candidate is not null and source is not null and fp is not null")
    done = fine.groupBy("candidate", "source", "bucket", "fp").agg(F.count("*").alias("samples"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    persistent(lambda: done.write.mode("overwrite").parquet(f"{out}/batch={batch}"))


def start(spark: SparkSession, discovery: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads what the tagging stream wrote since the last run, with a checkpoint of its own."""
    rows = spark.readStream.schema(DISCOVERED).option("recursiveFileLookup", "true").parquet(discovery)
    return rows.writeStream.foreachBatch(lambda r, b: absorb(r, b, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidates(spark: SparkSession, out: str) -> DataFrame:
    """(candidate, source, samples, first, last, n_shapes) over all batches."""
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy("candidate").agg(F.min("source").alias("source"), F.sum("samples").alias("samples"), F.min("first").alias("first"), F.max("last").alias("last"), F.count_distinct("bucket", "fp").alias("n_shapes"))


def stop_reason(seen: int, wanted: int, idle_s: float, most_idle_s: float, elapsed_s: float, deadline_s: float) -> str | None:
    """Why a measurement of a stream may stop now; null while it may not."""
    if seen >= wanted:
        return "reached"
    if idle_s >= most_idle_s:
        return "idle"
    return "deadline" if elapsed_s >= deadline_s else None
