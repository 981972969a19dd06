"""Names for schemas from the words of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words of fields that say nothing about what a record is.
PLUMBING = (
    "id", "uuid", "guid", "url", "uri", "href", "link", "ts", "time", "timestamp", "date", "datetime", "created", "updated", "modified", "at", "version", "rev", "type",
    "kind", "data", "items", "item", "list", "array", "object", "node", "children", "key", "value", "val", "meta", "metadata", "self", "count", "index", "idx", "hash",
    "etag", "seq", "dtime", "dt", "utc", "tz", "zone", "offset", "epoch", "millis", "ms", "nanos", "secs", "pomiar", "pomiaru", "stan", "status",
)

# Words that a schema must have, and the name that then fits; the first match counts.
SIGNATURES = [
    (("doi",), "Scholarly Works"), (("latitude", "longitude"), "Location Observations"), (("claims", "labels", "sitelinks"), "Knowledge Graph Entities"),
    (("repository", "actor"), "Repository Events"), (("carbon",), "Carbon Intensity Readings"), (("price", "currency"), "Price Listings"),
    (("power", "generation"), "Power Generation Readings"), (("magnitude", "depth"), "Seismic Events"), (("downloads",), "Package Downloads"),
    (("benchmark",), "Benchmark Results"), (("temperature", "humidity"), "Weather Readings"), (("callsign",), "Flight Positions"),
]


def tokens(name: Column) -> Column:
    """Words of a field's name, without digits alone."""
    cut = F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[._\-/\[\]]+", " "))
    words = F.transform(F.split(cut, r"\s+"), lambda w: F.regexp_replace(w, r"[^a-z0-9]", ""))
    return F.filter(words, lambda w: (w != "") & ~w.rlike(r"^[0-9]+$"))


def names(fields: DataFrame) -> DataFrame:
    """(schema_id, name) from leaf fields (schema_id, field): a signature's name, else the two most frequent telling words."""
    words = fields.select("schema_id", F.explode(tokens(F.col("field"))).alias("w"))
    plain = F.broadcast(fields.sparkSession.createDataFrame([(w,) for w in PLUMBING], "w string"))
    counts = words.join(plain, "w", "left_anti").groupBy("schema_id", "w").agg(F.count("*").alias("n"))
    top = W.partitionBy("schema_id").orderBy(F.desc("n"), "w")
    best = counts.withColumn("r", F.row_number().over(top)).where("r <= 2").groupBy("schema_id").agg(F.sort_array(F.collect_list(F.struct("r", F.initcap("w").alias("w")))).alias("best"))
    wanted = sorted({w for need, _ in SIGNATURES for w in need})
    have = words.where(F.col("w").isin(*wanted)).groupBy("schema_id").agg(F.collect_set("w").alias("have"))
    signed = F.coalesce(*[F.when(F.size(F.array_intersect("have", F.array(*map(F.lit, need)))) == len(need), F.lit(name)) for need, name in SIGNATURES])
    plainly = F.concat(F.array_join(F.transform("best", lambda b: b["w"]), " "), F.lit(" Records"))
    ids = fields.select("schema_id").distinct()
    return ids.join(best, "schema_id", "left").join(have, "schema_id", "left").select("schema_id", F.coalesce(signed, plainly, F.lit("Records")).alias("name"))


def licensed(name: Column, words: Column) -> Column:
    """Whether every word of a name is one of those allowed, and the name is short and plain."""
    own = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    return (F.size(own) > 0) & F.forall(own, lambda w: F.array_contains(words, w)) & (F.length(name) <= 40) & name.rlike(r"^[A-Za-z0-9 ]+$")
