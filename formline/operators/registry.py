"""The registry as tables: publishing, variants, families, listings and checks of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def publish(registry: DataFrame, drafts: DataFrame) -> DataFrame:
    """The registry with drafts (schema_id, family_id, canonical, order) that are new, numbered on in their family.

    A draft that is there already keeps its version, so publishing again changes nothing. A draft
    with the id of a schema of other content raises. Run by one writer at a time.
    """
    clash = drafts.alias("d").join(registry.alias("r"), "schema_id").where(F.col("d.canonical") != F.col("r.canonical")).select("schema_id")
    if row := clash.first():
        raise ValueError(f"schema {row[0]} is immutable")
    first = W.partitionBy("schema_id").orderBy("order", "family_id")
    new = drafts.withColumn("__n", F.row_number().over(first)).where("__n = 1").join(registry.select("schema_id"), "schema_id", "left_anti")
    last = registry.groupBy("family_id").agg(F.max("version").alias("__last"))
    by_family = W.partitionBy("family_id").orderBy("order", "schema_id")
    numbered = new.withColumn("__n", F.row_number().over(by_family)).join(last, "family_id", "left")
    added = numbered.select("schema_id", "family_id", "canonical", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long").alias("version"))
    return registry.select("schema_id", "family_id", "canonical", "version").unionByName(added)


def variant_index(schemas: DataFrame, variants: DataFrame) -> DataFrame:
    """(bucket, fp, schema_id): a schema's own fingerprint and every concrete one seen for it; the least id wins a tie."""
    both = schemas.select("bucket", "fp", "schema_id").unionByName(variants.select("bucket", "fp", "schema_id"))
    return both.groupBy("bucket", "fp").agg(F.min("schema_id").alias("schema_id"))


def verify_index(index: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, bucket, fp): dangling entries that nothing explains, and missing ones."""
    keys = ["bucket", "fp"]
    dangling = index.select(*keys).join(expected.select(*keys), keys, "left_anti").select(F.lit("dangling").alias("problem"), *keys)
    missing = expected.select(*keys).join(index.select(*keys), keys, "left_anti").select(F.lit("missing").alias("problem"), *keys)
    return dangling.unionByName(missing)


def page(rows: DataFrame, key: str, after=None, size: int = 100) -> DataFrame:
    """The next rows in the order of a unique key; the last key is the cursor."""
    found = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return found.orderBy(key).limit(size)


def families(registry: DataFrame) -> DataFrame:
    """(family_id, versions, latest): contiguous versions from 1, and the schema of the last."""
    return registry.groupBy("family_id").agg(F.max("version").alias("versions"), F.max_by("schema_id", "version").alias("latest"))


def sources(seen: DataFrame) -> DataFrame:
    """(source, first_seen, last_seen, n) of observations (source, at)."""
    return seen.groupBy("source").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("n"))


def resolve_alias(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidate ids (id) with the schema that they were promoted to, or themselves."""
    return ids.join(aliases.withColumnRenamed("candidate", "id"), "id", "left").withColumn("resolved", F.coalesce("schema_id", "id"))


def in_buckets(schemas: DataFrame, index: DataFrame, buckets: list[str]) -> DataFrame:
    """Schemas (schema_id, ...) with a shape in one of the buckets, each once; none without buckets."""
    found = index.where(F.col("bucket").isin(*buckets)) if buckets else index.limit(0)
    return schemas.join(found.select("schema_id").distinct(), "schema_id", "left_semi")


def malformed(index: DataFrame, prefix: str = "formline") -> DataFrame:
    """Index entries whose bucket or fingerprint cannot be one."""
    return index.where(~F.coalesce(F.col("bucket").rlike(rf"^{prefix}:index:[0-9]+:[0-9]+:[0-9a-f]{{8}}$") & F.col("fp").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(F.lit("malformed").alias("problem"), "bucket", "fp")


def enriched(events: DataFrame, schemas: DataFrame, candidates: DataFrame) -> DataFrame:
    """Events (schema_id, candidate, fate) with the family of their schema or the samples of their candidate, and what they tell: a candidate seen before is matched, not new."""
    out = events.join(schemas.select("schema_id", "family_id"), "schema_id", "left").join(candidates.select("candidate", "samples"), "candidate", "left")
    told = F.when(F.col("fate") == "known", "matched_schema").when((F.col("fate") == "provisional") & (F.coalesce("samples", F.lit(0)) >= 2), "matched_candidate").when(F.col("fate") == "provisional", "new_candidate").otherwise(F.col("fate"))
    return out.withColumn("told", told)
