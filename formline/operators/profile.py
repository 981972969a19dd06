"""Profiles: per-path statistics that merge by ordinary aggregation.

A document gives one row per node; a profile is those rows grouped by path. Counts add, flags
combine with or (``whole`` with and), bucket masks with bitwise or, so partial aggregation is the
merge, in any order and any number of steps.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.identity import DEFAULT_TAGS, IdentityTags
from ..session import ship

TYPES = ("t_null", "t_bool", "t_num", "t_str", "t_arr", "t_obj")
FLAGS = ("empty_seen", "partial_seen", "minus_zero")


def profile(occurrences: DataFrame, *by: str) -> DataFrame:
    """Merged statistics by ``by`` and path, from rows of single nodes."""
    count = [F.count_if(F.col("kind") == i).alias(t) for i, t in enumerate(TYPES)]
    return occurrences.groupBy(*by, "path").agg(
        F.min("parent").alias("parent"), F.count("*").alias("present"), *count,
        F.bool_or("empty").alias("empty_seen"), F.bool_or("partial").alias("partial_seen"), F.bool_or("minus_zero").alias("minus_zero"),
        F.bool_and("whole").alias("whole"), F.bit_or("mask").alias("mask"),
    )


def merge(profiles: DataFrame, *by: str) -> DataFrame:
    """Profiles of parts into those of the whole."""
    return profiles.groupBy(*by, "path").agg(
        F.min("parent").alias("parent"), F.sum("present").alias("present"), *[F.sum(t).alias(t) for t in TYPES],
        *[F.bool_or(f).alias(f) for f in FLAGS], F.bool_and("whole").alias("whole"), F.bit_or("mask").alias("mask"),
    )


def with_denominators(profiles: DataFrame, *by: str) -> DataFrame:
    """``denom``: how often a path could have been present; a path seen less often is ``optional``."""
    parents = profiles.select(*by, F.col("path").alias("parent"), F.col("t_obj").alias("__objects"), F.col("t_arr").alias("__arrays"))
    joined = profiles.join(parents, [*by, "parent"], "left")
    denom = F.when(F.col("path") == "", F.col("present")).when(F.col("path").endswith("/~*"), F.col("__arrays")).otherwise(F.col("__objects"))
    return joined.withColumn("denom", denom).withColumn("optional", F.col("present") < F.col("denom")).drop("__objects", "__arrays")


def leaves(profiles: DataFrame, *by: str) -> DataFrame:
    """Paths with nothing below them; the root is none."""
    inner = profiles.where("parent is not null").select(*by, F.col("parent").alias("path")).distinct()
    return profiles.where("path <> ''").join(inner, [*by, "path"], "left_anti")


def leaf_counts(profiles: DataFrame, *by: str) -> DataFrame:
    """Leaves of each profile, and how many of them every chance had."""
    return leaves(with_denominators(profiles, *by), *by).groupBy(*by).agg(F.count("*").alias("n_leaves"), F.count_if((F.col("present") == F.col("denom")) & (F.col("denom") > 0)).alias("n_required"))


def summary(profiles: DataFrame, *by: str) -> DataFrame:
    """Top-level fields and depth, as of a shape; depth counts containers and the value in them."""
    steps = F.size(F.split("path", "/")) - 1
    top = (steps == 1) & ~F.col("path").endswith("/~*")
    return profiles.groupBy(*by).agg(F.count_if(top).alias("n_fields"), (F.max(steps) + 1).alias("depth"), F.sort_array(F.collect_list(F.when(top, F.substring("path", 2, 1 << 30)))).alias("keys"))


def fingerprint(body: str, tags: IdentityTags = DEFAULT_TAGS) -> str:
    """Hex digest of a canonical form."""
    framed = f'{{"gen":"{tags.generalizer}","fields":{body}}}'
    return hashlib.sha256(f"{tags.generalizer}\0{framed}".encode()).hexdigest()


def generalized(profiles: DataFrame, documents: DataFrame, by: str, tags: IdentityTags = DEFAULT_TAGS) -> DataFrame:
    """(by, canonical, fingerprint, simhash) of each profile; ``documents`` has (by, n). A canonical form is one value, and its paths meet in one task."""
    ship(profiles.sparkSession)
    rows = profiles.join(documents, by).select(by, "path", "n", *TYPES)

    def assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        paths = {p: tuple(map(int, c)) for p, c in zip(pdf["path"], pdf[list(TYPES)].to_numpy(), strict=True)}
        body = shapes.generalized(paths, int(pdf["n"].iloc[0]))
        return pd.DataFrame({by: [key[0]], "canonical": [body], "fingerprint": [fingerprint(body, tags)]})

    kind = profiles.schema[by].dataType.simpleString()
    built = rows.groupBy(by).applyInPandas(assemble, f"{by} {kind}, canonical string, fingerprint string")
    return documents.select(by).join(built, by, "left").join(simhash(profiles, by, tags), by, "left")


def label(path: Column) -> Column:
    """A path as in structural tokens: ``$``, keys joined by points, ``[]`` for elements."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/~\*", "[]"), "/", ".")
    bare = F.replace(F.replace(F.when(plain.startswith("."), F.substring(plain, 2, 1 << 30)).otherwise(plain), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.when(path == "", F.lit("$")).otherwise(bare)


def simhash(profiles: DataFrame, by: str, tags: IdentityTags = DEFAULT_TAGS) -> DataFrame:
    """(by, simhash): 64 bits of the majority over hashes of ``label:type`` tokens, as 16 hex digits."""
    names = dict(zip(TYPES, ("null", "bool", "number", "string", "array", "object"), strict=True))
    present = F.array_compact(F.array(*[F.when(F.col(t) > 0, F.lit(n)) for t, n in names.items()]))
    tokens = profiles.select(by, F.explode(present).alias("type"), label(F.col("path")).alias("label"))
    digest = F.sha2(F.concat(F.lit(f"{tags.simhash}\0".encode()), F.concat_ws(":", "label", "type").cast("binary")), 256)
    # Two halves of 32 bits, as a long has a sign.
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    bit = lambda i: F.shiftright("high" if i < 32 else "low", 31 - i % 32).bitwiseAND(F.lit(1))
    votes = tokens.select(by, high.alias("high"), low.alias("low")).groupBy(by).agg(F.count("*").alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(64)])
    half = lambda lo: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"b{lo + i}") * 2 > F.col("n"), F.lit(1 << (31 - i)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(32)])
    return votes.select(by, F.concat(*[F.lpad(F.lower(F.hex(half(lo))), 8, "0") for lo in (0, 32)]).alias("simhash"))


def fields(profiles: DataFrame, by: str) -> DataFrame:
    """(by, path, types, optional) of generalized schemas: each path's sorted types, and whether it was lacking where it could have been."""
    names = sorted(zip(("null", "bool", "number", "string", "array", "object"), TYPES, strict=True))
    types = F.array_compact(F.array(*[F.when(F.col(t) > 0, F.lit(n)) for n, t in names]))
    return with_denominators(profiles, by).select(by, "path", types.alias("types"), "optional")


def from_shapes(shapes_of: DataFrame, *by: str) -> DataFrame:
    """Profiles of shapes (by, canonical, n): each shape counts as n documents, and numbers, of which only the kind is known, have no buckets."""
    ship(shapes_of.sparkSession)
    out = "path string, parent string, kind int, empty boolean, partial boolean"

    @F.pandas_udf(f"array<struct<{', '.join(':'.join(x.split()) for x in out.split(', '))}>>")
    def nodes(values: pd.Series) -> pd.Series:
        return values.map(lambda c: None if c is None else [dict(zip(("path", "parent", "kind", "empty", "partial"), x, strict=True)) for x in shapes.shape_nodes(json.loads(c))])

    seen = shapes_of.select(*by, "n", F.explode(nodes("canonical")).alias("o")).select(*by, "n", "o.*")
    count = [F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(t) for i, t in enumerate(TYPES)]
    return seen.groupBy(*by, "path").agg(
        F.min("parent").alias("parent"), F.sum("n").alias("present"), *count, F.bool_or("empty").alias("empty_seen"), F.bool_or("partial").alias("partial_seen"),
        F.lit(False).alias("minus_zero"), F.lit(True).alias("whole"), F.lit(0).alias("mask"),
    )
