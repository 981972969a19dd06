"""Seeded streams of JSON records with a known number of schemas, churn, drift and malformed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Optional fields, of which a family has those whose bit it sets.
POOL = {
    "user_id": "concat('u', id)", "session": "concat('s', id % 97)", "score": "id % 100 / 10", "active": "id % 2 = 0", "tags": "array('a', 'b')",
    "geo": "named_struct('lat', id % 90, 'lon', id % 180)", "price": "id % 1000 / 100", "currency": "'EUR'", "count": "id % 7", "status": "'ok'",
}


def _share(seed: int, salt: str) -> Column:
    """A number from 0 to 1 for each id, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1_000_000)) / 1_000_000


def records(spark: SparkSession, n: int, families: int = 16, seed: int = 0, churn: float = 0.0, malformed: float = 0.0) -> DataFrame:
    """(id, family, value): JSON of core fields, the family's fields, and an optional note."""
    rows = spark.range(n).withColumn("family", (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(families)) + 1).cast("int"))
    fields = [F.concat(F.lit("e"), "id").alias("id"), F.lit("event").alias("kind"), (F.col("id") + 1_700_000_000).alias("created_at")]
    fields += [F.when(F.col("family").bitwiseAND(1 << i) != 0, F.expr(sql)).alias(name) for i, (name, sql) in enumerate(POOL.items())]
    fields.append(F.when(_share(seed, "churn") < churn, F.lit("note")).alias("notes"))
    good = F.to_json(F.struct(*fields))
    kind = F.pmod(F.xxhash64(F.lit(seed), F.lit("kind"), "id"), F.lit(3))
    bad = F.when(kind == 0, F.replace(good, F.lit('{"id":'), F.lit('{"id":0,"id":'))).when(kind == 1, F.regexp_replace(good, r'"created_at":\d+', '"created_at":NaN')).otherwise(F.substring(good, F.lit(1), F.floor(F.length(good) * 2 / 3).cast("int")))
    return rows.select("id", "family", F.when(_share(seed, "malformed") < malformed, bad).otherwise(good).alias("value"))


def round_robin(spark: SparkSession, documents: list[str], n: int) -> DataFrame:
    """(id, fixture, value): n records that go round a few documents."""
    fixtures = spark.createDataFrame(list(enumerate(documents)), "fixture long, value string")
    return spark.range(n).withColumn("fixture", F.col("id") % len(documents)).join(F.broadcast(fixtures), "fixture").select("id", "fixture", "value")
