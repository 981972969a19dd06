"""Records derived from the test tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SOURCE = "concat('events.', CASE user_id % 5 WHEN 0 THEN 'compute' WHEN 1 THEN 'energy' WHEN 2 THEN 'weather' WHEN 3 THEN 'grid' ELSE 'misc' END, '.c', CAST(user_id % 3 AS STRING))"

#: Eight kinds of payload: four shapes that parse, two that do not, a tombstone, and one more shape.
VALUE = """CASE event_id % 8
 WHEN 0 THEN concat('{"id":', CAST(event_id AS STRING), ',"kind":"', event_type, '","amount":', CAST(user_id AS STRING), '}')
 WHEN 1 THEN concat('{"id":', CAST(event_id AS STRING), ',"user":{"id":', CAST(user_id AS STRING), ',"tags":["a","b"]}}')
 WHEN 2 THEN concat('{"tags":[', CAST(user_id AS STRING), ',"x",null],"id":', CAST(event_id AS STRING), '}')
 WHEN 3 THEN concat('{"id":', CAST(event_id AS STRING), ',"tags":[]}')
 WHEN 4 THEN concat('{"id":', CAST(event_id AS STRING), ',"id":', CAST(user_id AS STRING), '}')
 WHEN 5 THEN concat('{"id":', CAST(event_id AS STRING), ',"kind":')
 WHEN 7 THEN concat('{"id":', CAST(event_id AS STRING), ',"kind":null,"amount":-', CAST(user_id AS STRING), '.50}')
 END"""

RECORDS = f"SELECT event_id AS rec_id, user_id, event_type, {SOURCE} AS source, {VALUE} AS value FROM events"

#: Canonical shapes of the kinds that parse.
CANONICAL = {
    0: '{"t":"obj","f":{"amount":{"t":"num"},"id":{"t":"num"},"kind":{"t":"str"}}}',
    1: '{"t":"obj","f":{"id":{"t":"num"},"user":{"t":"obj","f":{"id":{"t":"num"},"tags":{"t":"arr","e":"nonempty","of":[{"t":"str"}]}}}}}',
    2: '{"t":"obj","f":{"id":{"t":"num"},"tags":{"t":"arr","e":"nonempty","of":[{"t":"null"},{"t":"num"},{"t":"str"}]}}}',
    3: '{"t":"obj","f":{"id":{"t":"num"},"tags":{"t":"arr","e":"empty","of":[]}}}',
    7: '{"t":"obj","f":{"amount":{"t":"num"},"id":{"t":"num"},"kind":{"t":"null"}}}',
}
#: Top-level fields, depth and sorted keys of the same.
SUMMARY = {0: (3, 2, ["amount", "id", "kind"]), 1: (2, 4, ["id", "user"]), 2: (2, 3, ["id", "tags"]), 3: (2, 2, ["id", "tags"]), 7: (3, 2, ["amount", "id", "kind"])}


def case(of: dict, default: str = "NULL") -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in of.items()) + f" ELSE {default} END"


def canonical_case() -> str:
    return case({k: f"'{v}'" for k, v in CANONICAL.items()})


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of tables."""
    ship(spark)
    for n in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over views of the tables that it names."""
    views(spark, sf_dir, *[n for n in TABLES if n in text])
    return spark.sql(text)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RECORDS)
