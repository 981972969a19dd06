"""Reshaping of collected documents into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unwrap(rows: DataFrame, json: str, at: str = "$") -> DataFrame:
    """One row per element of the array at a path; an object there is one row, anything else none."""
    found = F.try_variant_get(F.try_parse_json(json), at, "variant")
    items = F.when(F.schema_of_variant(found).startswith("ARRAY"), found.try_cast("array<variant>")).when(F.schema_of_variant(found).startswith("OBJECT"), F.array(found))
    return rows.withColumn("item", F.explode(items))


def entries(rows: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per entry of a map."""
    return rows.select("*", F.explode(column).alias(key, value))


def zipped(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per place of parallel arrays, with its number."""
    z = F.arrays_zip(*columns)
    return rows.select(*[c for c in rows.columns if c not in columns], F.posexplode(z).alias("place", "__z")).select("*", *[F.col(f"__z.{c}") for c in columns]).drop("__z")


def named(column: Column, names: list[str]) -> list[Column]:
    """Places of an array as columns; null beyond its end."""
    return [F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)]


def unwrapped_call(text: Column) -> Column:
    """JSON inside ``callback(...)``; as it is without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)^\s*[A-Za-z_$][\w$.]*\((.*)\)\s*;?\s*$", 1), F.lit("")), text)


def regroup(rows: DataFrame, by: str, item: Column) -> DataFrame:
    """Items that are there, collected again in their order."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("items"))


def nested_entries(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """One row per entry of maps in maps: a key for each level but the last name, which is the innermost value."""
    out = rows.withColumnRenamed(column, "__m")
    for name in names[:-1]:
        out = out.select(*[c for c in out.columns if c != "__m"], F.explode("__m").alias(name, "__m"))
    return out.withColumnRenamed("__m", names[-1])


def having(rows: DataFrame, needs: str, none_of: tuple[str, list]) -> DataFrame:
    """Rows whose array ``needs`` has an element, and where no element of another array is one of those named; a lacking array has none."""
    column, banned = none_of
    return rows.where((F.coalesce(F.size(needs), F.lit(0)) > 0) & ~F.coalesce(F.exists(column, lambda x: x.isin(*banned)), F.lit(False)))
