"""Structural retrieval: distances between schemas' features, and the nearest families."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of the distances.
WEIGHTS = {"path_type": 0.35, "names": 0.25, "required": 0.15, "depth": 0.10, "nullability": 0.10, "containers": 0.05}
TIE = 1e-6


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 less the shared part of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def depth_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name, split at what is no letter or digit and before capitals; 16 of 40 characters at most. Names are taken as composed (NFC), as ``composed`` gives them."""
    cut = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    words = F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(F.slice(words, 1, 16), lambda x: F.substring(x, 1, 40))


def composed(name: Column) -> Column:
    """Unicode composition of names that hold more than ASCII."""
    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.when(F.length(name) == F.octet_length(name), name).otherwise(nfc(name))


def features(fields: DataFrame, by: str) -> DataFrame:
    """(by, types, required, nullable, arrays, objects, kinds, tokens, depth) of schemas' fields (by, path, types, optional); the root is none of them.

    ``types`` maps each path to its sorted types. A schema is one value, and its paths meet in one row.
    """
    steps = F.size(F.split("path", "/")) - 1
    last = F.element_at(F.split("path", "/"), -1)
    plain = F.replace(F.replace(last, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    tokens = F.when(last != "~*", name_tokens(plain)).otherwise(F.array().cast("array<string>"))
    having = lambda t: F.sort_array(F.collect_set(F.when(F.array_contains("types", t), F.col("path"))))
    return fields.where("path <> ''").withColumn("__tokens", tokens).groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("path", "types"))).alias("types"), F.sort_array(F.collect_set(F.when(~F.col("optional"), F.col("path")))).alias("required"),
        having("null").alias("nullable"), having("array").alias("arrays"), having("object").alias("objects"),
        F.array_distinct(F.flatten(F.collect_set("types"))).alias("kinds"), F.array_distinct(F.flatten(F.collect_set("__tokens"))).alias("tokens"), F.max(steps).alias("depth"),
    )


def distances(pairs: DataFrame, a: str = "q", b: str = "r") -> DataFrame:
    """Adds the weighted ``distance`` of two structs of features, with its parts, in single precision."""
    get = lambda side, c: F.col(f"{side}.{c}")
    j = lambda c: jaccard_distance(get(a, c), get(b, c))
    paths = F.array_union(F.map_keys(get(a, "types")), F.map_keys(get(b, "types")))
    one = lambda p: F.coalesce(jaccard_distance(F.element_at(get(a, "types"), p), F.element_at(get(b, "types"), p)), F.lit(1.0))
    each = F.transform(paths, one)
    parts = {
        "path_type": F.when(F.size(paths) == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / F.size(paths)),
        "names": j("tokens"), "required": j("required"), "depth": depth_distance(get(a, "depth"), get(b, "depth")),
        "nullability": (j("nullable") + j("kinds")) / 2, "containers": (j("arrays") + j("objects")) / 2,
    }
    return pairs.select("*", *[F.round(c, 6).alias(n) for n, c in parts.items()], total(parts).cast("float").alias("distance"))


def retrieve(queries: DataFrame, schemas: DataFrame, k: int = 3) -> DataFrame:
    """Ranked families of each query from band and depth to ties: ``queries`` (query, n_fields, depth, f) and ``schemas`` (schema_id, family_id, version, n_fields, depth, band, f), f being a struct of features."""
    asked = queries.select(F.col("query").alias("schema_id"), "n_fields", "depth")
    found = candidates(asked, schemas, "schema_id")
    joined = found.join(queries.select("query", F.col("f").alias("q")), "query").join(schemas.select("schema_id", "family_id", "version", F.col("f").alias("r")), "schema_id")
    scored = distances(joined).select("query", "family_id", "schema_id", "version", "distance")
    return rank(scored, k)


def path_type_distance(pairs: DataFrame, paths: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(a, b, path_type) of pairs: the mean over all paths of either of their types' distance, 1 where one lacks the path."""
    left = pairs.select(a, b).join(paths.select(F.col(key).alias(a), "path", F.col("types").alias("__ta")), a)
    right = pairs.select(a, b).join(paths.select(F.col(key).alias(b), "path", F.col("types").alias("__tb")), b)
    both = left.join(right, [a, b, "path"], "full")
    each = F.when(F.col("__ta").isNull() | F.col("__tb").isNull(), F.lit(1.0)).otherwise(jaccard_distance(F.col("__ta"), F.col("__tb")))
    return both.groupBy(a, b).agg(F.avg(each).alias("path_type"))


def total(distances: dict[str, Column]) -> Column:
    return reduce(lambda x, y: x + y, [distances[n] * w for n, w in WEIGHTS.items()])


def candidates(queries: DataFrame, schemas: DataFrame, key: str) -> DataFrame:
    """(query, key) of schemas whose field band and depth lie around the query's; both have (key, n_fields, band, depth).

    The neighbouring bands and depths are listed and joined by equality.
    """
    band = lambda n: F.when(n <= 0, F.lit(0)).when(n == 1, F.lit(1)).otherwise(F.pow(F.lit(2), F.length(F.bin(n - 1)))).cast("long")
    n, d = F.col("n_fields").cast("long"), F.col("depth")
    near = queries.select(
        F.col(key).alias("query"),
        F.explode(F.array_distinct(F.array(band(n - 1), band(n), band(n + 1)))).alias("band"),
        F.array_distinct(F.array(F.greatest(d - 1, F.lit(0)), d, d + 1)).alias("__d"),
    ).withColumn("depth", F.explode("__d")).drop("__d")
    return near.join(schemas.select(key, "band", "depth"), ["band", "depth"]).select("query", key)


def rank(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest families of each query by their best schema, from (query, family_id, schema_id, version, distance).

    ``margin`` is the distance from the first to the second, 0 with fewer than two. Families as near as the last of the k,
    within ``TIE``, are kept with its rank and ``tie`` set.
    """
    best = W.partitionBy("query", "family_id").orderBy("distance", "version", "schema_id")
    order = W.partitionBy("query").orderBy("distance", "family_id")
    one = scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    ranked = one.withColumn("rank", F.row_number().over(order)).withColumn("__next", F.lead("distance").over(order))
    margin = F.first(F.coalesce(F.col("__next") - F.col("distance"), F.lit(0.0))).over(order)
    edge = F.max(F.when(F.col("rank") <= k, F.col("distance"))).over(W.partitionBy("query"))
    ranked = ranked.withColumn("margin", margin if k > 1 else F.lit(0.0)).withColumn("__edge", edge)
    ranked = ranked.where((F.col("rank") <= k) | (F.abs(F.col("distance") - F.col("__edge")) <= TIE))
    return ranked.withColumn("tie", F.col("rank") > k).withColumn("rank", F.least("rank", F.lit(k))).drop("__next", "__edge")


def _flips(bits: int, most: int) -> list[int]:
    """All words of so many bits with at most ``most`` of them set."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def hamming_neighbours(sketches: DataFrame, radius: int = 8) -> DataFrame:
    """(id, other, hamming) of pairs of (id, simhash as bigint) within ``radius`` bits.

    Of four words of 16 bits, two sketches within the radius differ in one by a quarter of it at most. One side lists all words
    within that of its own, the other its own, and they are joined by word and place: buckets hold 2^-16 of the rows, not 2^-7 as
    with radius + 1 words. A pair is told by the first place where it meets.
    """
    near = radius // 4
    word = lambda x, i: F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")
    flips = F.array(*[F.lit(x) for x in _flips(16, near)])
    placed = sketches.select("id", "simhash", F.posexplode(F.array(*[word(F.col("simhash"), i) for i in range(4)])).alias("i", "w"))
    listed = placed.select("id", "simhash", "i", F.explode(F.transform(flips, lambda x: F.col("w").bitwiseXOR(x))).alias("w"))
    other = placed.select(F.col("id").alias("other"), F.col("simhash").alias("__x"), "i", "w")
    differ = F.col("simhash").bitwiseXOR(F.col("__x"))
    earlier = [F.when((F.col("i") > i) & (F.bit_count(word(differ, i)) <= near), True) for i in range(3)]
    pairs = listed.join(other, ["i", "w"]).where("id <> other").where(F.coalesce(*earlier, F.lit(False)) == F.lit(False))
    return pairs.select("id", "other", F.bit_count(differ).alias("hamming")).where(F.col("hamming") <= radius)
