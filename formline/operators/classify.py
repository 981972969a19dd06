"""The hot path: what schema a record has, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_TAGS, IdentityTags, bucket_key, candidate_digest, shape_fingerprint
from ..functions.records import parse_records
from ..functions.strictjson import Limits

#: Rows of an index that is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def with_identity(records: DataFrame, value: str = "value", limits: Limits = Limits(), tags: IdentityTags = DEFAULT_TAGS) -> DataFrame:
    """Parsed records with ``fp`` and ``bucket``; both null for what is no document."""
    parsed = parse_records(records, value, limits)
    fp = F.when(F.col("canonical").isNotNull(), shape_fingerprint(F.col("canonical"), tags))
    bucket = F.when(F.col("canonical").isNotNull(), bucket_key(F.col("n_fields"), F.col("depth"), F.col("keys")))
    return parsed.withColumn("fp", fp).withColumn("bucket", bucket)


def classify(identified: DataFrame, index: DataFrame | None, value: str = "value", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``fate`` and ``schema_id``. ``index`` has (bucket, fp, schema_id), one row per (bucket, fp).

    Fates: tombstone, malformed, known, provisional. The index is broadcast if it is counted small. Without an index, as when the
    registry cannot be read, documents are ``unresolved`` and get no candidate.
    """
    if index is None:
        fate = F.when(F.col(value).isNull(), "tombstone").when(F.col("reason").isNotNull(), "malformed").otherwise("unresolved")
        return identified.select("*", F.lit(None).cast("string").alias("schema_id"), fate.alias("fate"), F.lit(None).cast("string").alias("candidate"))
    side = index.select("bucket", "fp", F.col("schema_id"))
    if index.limit(broadcast_rows + 1).count() <= broadcast_rows:
        side = F.broadcast(side)
    joined = identified.join(side, ["bucket", "fp"], "left")
    fate = (
        F.when(F.col(value).isNull(), "tombstone").when(F.col("reason").isNotNull(), "malformed")
        .when(F.col("schema_id").isNotNull(), "known").otherwise("provisional")
    )
    cand = F.when(fate == "provisional", candidate_digest(F.col("source"), F.col("fp")))
    return joined.withColumn("fate", fate).withColumn("candidate", cand)


#: Room for headers in a message of the largest size.
HEADROOM = 16 << 10


def oversized(max_message_bytes: int, value: str = "value") -> Column:
    """Whether a record leaves no room for its headers in a message; such a one goes to quarantine and nowhere else."""
    return F.coalesce(F.octet_length(value) > max_message_bytes - HEADROOM, F.lit(False))


def quarantine(classified: DataFrame, max_message_bytes: int, value: str = "value") -> DataFrame:
    """Malformed records with their reason; a payload too large to forward is left out."""
    over = oversized(max_message_bytes, value)
    kept = classified.where((F.col("fate") == "malformed") | over)
    return kept.withColumn("reason", F.when(over, "size_exceeded").otherwise(F.col("reason"))).withColumn(value, F.when(~over, F.col(value)))


def tag_headers(headers: Column, tag: Column, origin: Column, tags: IdentityTags = DEFAULT_TAGS) -> Column:
    """Headers without those that carry the reserved prefix in any case, then the schema tag and the origin."""
    kept = F.filter(headers, lambda h: ~F.lower(h["key"]).startswith(tags.header_prefix))
    own = [F.struct(F.lit(f"{tags.header_prefix}{n}").alias("key"), c.cast("binary").alias("value")) for n, c in (("schema", tag), ("origin", origin))]
    return F.concat(kept, F.array(*own))
