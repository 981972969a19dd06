"""Content identities: tags, digests as columns, and prefixed ids."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IdentityTags:
    """Version tags that enter digests, and the prefix of header names."""

    canon: str = "formline-shape-v1"
    generalizer: str = "formline-gen-v1"
    simhash: str = "formline-simhash-v1"
    vocab: str = "formline-vocab-v1"
    header_prefix: str = "x-formline-"


DEFAULT_TAGS = IdentityTags()


def tagged_digest(tag: str, body: Column) -> Column:
    """Hex SHA-256 of the tag, a zero byte, and the body."""
    return F.sha2(F.concat(F.lit(f"{tag}\0".encode()), body.cast("binary")), 256)


def shape_fingerprint(canonical: Column, tags: IdentityTags = DEFAULT_TAGS) -> Column:
    return tagged_digest(tags.canon, canonical)


def generalized_fingerprint(body: Column, tags: IdentityTags = DEFAULT_TAGS) -> Column:
    framed = F.concat(F.lit(f'{{"gen":"{tags.generalizer}","fields":'), body, F.lit("}"))
    return tagged_digest(tags.generalizer, framed)


def candidate_digest(source: Column, fingerprint: Column) -> Column:
    """Digest of a candidate: its source and its shape's fingerprint (hex), so that sources never share one."""
    return F.sha2(F.concat(source.cast("binary"), F.lit(b"\0"), F.unhex(fingerprint)), 256)


def source_digest(source: Column) -> Column:
    return F.sha2(F.concat(F.lit("s"), source).cast("binary"), 256)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=").lower()


def prefixed_id(prefix: str, hex_digest: Column) -> Column:
    """``sch_``, ``cand_`` and the like: the prefix and the digest in lower-case base 32 without padding."""

    @F.pandas_udf("string")
    def encoded(hexes: pd.Series) -> pd.Series:
        return hexes.map(lambda x: None if x is None else base32(bytes.fromhex(x)))

    return F.concat(F.lit(f"{prefix}_"), encoded(hex_digest))


def field_band(n: Column) -> Column:
    """0, or the least power of two that is no smaller; by the bits of n - 1, so exact."""
    return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(1)).otherwise(F.expr("1").cast("long") * F.pow(F.lit(2), F.length(F.bin(n - 1)))).cast("long")


def bucket_key(n_fields: Column, depth: Column, keys: Column, prefix: str = "formline") -> Column:
    """``prefix:index:band:depth:`` and 8 hex digits of the hash of the sorted top keys."""
    joined = F.sha2(F.array_join(keys, "\0").cast("binary"), 256)
    return F.concat_ws(":", F.lit(f"{prefix}:index"), field_band(n_fields), depth, F.substring(joined, 1, 8))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
