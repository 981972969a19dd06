"""Annotations of schemas: vocabularies, paths, canonical literals, and digests of meaning."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import DEFAULT_TAGS, IdentityTags

# Units and currencies that annotations may name.
UCUM = ("1", "%", "By", "Cel", "K", "[degF]", "g", "kg", "L", "m", "mL", "mm", "cm", "km", "mol", "s", "ms", "min", "h", "d", "Hz", "V", "A", "W", "J", "N", "Pa")
ISO4217 = ("USD", "EUR", "GBP", "JPY", "PLN", "CHF", "CAD", "AUD", "NZD", "CNY", "INR", "BRL", "MXN", "ZAR", "SEK", "NOK", "DKK", "SGD", "HKD", "KRW")

_DECIMAL = re.compile(r"(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?")


def unit_problem(system: Column, code: Column) -> Column:
    """Why a unit cannot be used; null if it can, or if there is none."""
    known = F.when(system == "ucum", code.isin(*UCUM)).when(system == "iso4217", code.isin(*ISO4217)).when(system == "registered", F.btrim(code) != "").otherwise(F.lit(False))
    return F.when(code.isNotNull() & ~F.coalesce(known, F.lit(False)), F.concat_ws(":", F.lit("unknown_unit"), system, code))


def unknown(annotations: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Annotations whose value of a column is in no row of a vocabulary table."""
    return annotations.where(F.col(column).isNotNull()).join(vocabulary.select(column).distinct(), column, "left_anti")


def missing_paths(annotations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Annotated (schema_id, path) that the schema does not have."""
    return annotations.join(profiles.select("schema_id", "path"), ["schema_id", "path"], "left_anti")


def decimal(text: str) -> tuple[bool, str, int] | None:
    """(negative, digits, exponent) of a JSON number: equal for equal values; None if it is none."""
    m = _DECIMAL.fullmatch(text)
    if not m:
        return None
    sign, whole, part, power = m[1], m[2], m[3] or "", int(m[4] or 0)
    digits = (whole + part).lstrip("0")
    if not digits:
        return False, "0", 0
    bare = digits.rstrip("0")
    return sign == "-", bare, power - len(part) + len(digits) - len(bare)


def _string(text: str) -> bytes:
    raw = unicodedata.normalize("NFC", text).encode()
    return struct.pack(">I", len(raw)) + raw


def steps_of(canonical: str, canonicalizer: str, tags: IdentityTags = DEFAULT_TAGS) -> set[tuple[str | None, ...]]:
    """Every path of a canonical form as its steps, None being the step to an array's elements, for shapes and for generalized forms; another canonicalizer raises.

    An array has the step to its elements whether or not any were seen, if the form is a shape.
    """
    if canonicalizer not in (tags.canon, tags.generalizer):
        raise ValueError(f"unknown canonicalizer {canonicalizer}")
    out: set[tuple] = set()

    def walk(node: dict, at: tuple) -> None:
        if at:
            out.add(at)
        if canonicalizer == tags.canon:
            if node["t"] == "arr":
                out.add((*at, None))
            below = [*node.get("f", {}).items(), *((None, x) for x in node.get("of", ()))]
        else:
            below = [*node.get("children", {}).items(), *([(None, node["elem"])] if "elem" in node else [])]
        for key, x in below:
            walk(x, (*at, key))

    walk(json.loads(canonical), ())
    return out


def paths_of(canonical: Column, canonicalizer: str, tags: IdentityTags = DEFAULT_TAGS) -> Column:
    """The same as an array of paths in text."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        text = lambda steps: "".join("/~*" if s is None else f"/{s.replace('~', '~0').replace('/', '~1')}" for s in steps)
        return values.map(lambda c: None if c is None else sorted(text(s) for s in steps_of(c, canonicalizer, tags)))

    return run(canonical)


def path_bytes(steps: list[str | None]) -> bytes:
    """A path as bytes that sort and compare by its steps; None is the step to an array's elements."""
    if any(s is not None and any(unicodedata.category(c) == "Cc" for c in s) for s in steps):
        raise ValueError("control character in a path")
    return struct.pack(">I", len(steps)) + b"".join(b"\1" if s is None else b"\0" + _string(s) for s in steps)


def literal(value: object) -> bytes:
    """A typed literal: numbers by value, so that 1 and 1.0 are one and the string "1" is another."""
    if value is None:
        return b"\0"
    if isinstance(value, bool):
        return b"\1" + bytes([value])
    if isinstance(value, (int, float)):
        value = repr(value)
        found = decimal(value)
        if found is None:
            raise ValueError("not a number")
        return b"\2" + bytes([found[0]]) + _string(found[1]) + struct.pack(">q", found[2])
    return b"\3" + _string(str(value))


#: Attributes of a field in the order of their bits.
ATTRIBUTES = ("canonical_field_id", "identifier_namespace", "unit", "numeric_scale", "temporal", "enum")


def meaning(event: str | None, fields: dict[tuple, dict]) -> bytes | None:
    """Canonical bytes of annotations: fields by path, attributes by bit, those without any left out; None if nothing is said."""
    entries = []
    for steps, attributes in fields.items():
        bits, body = 0, b""
        for i, name in enumerate(ATTRIBUTES):
            value = attributes.get(name)
            if value is None or value == {} or value == "":
                continue
            bits |= 1 << i
            if isinstance(value, dict):
                pairs = sorted((literal(k), _string(str(v))) for k, v in value.items())
                if len({k for k, _ in pairs}) < len(pairs):
                    raise ValueError("two literals of an enum are equal")
                body += struct.pack(">I", len(pairs)) + b"".join(k + v for k, v in pairs)
            else:
                body += _string(str(value))
        if bits:
            entries.append(path_bytes(list(steps)) + bytes([bits]) + body)
    if event is None and not entries:
        return None
    head = b"\0" if event is None else b"\1" + _string(event)
    return head + struct.pack(">I", len(entries)) + b"".join(sorted(entries))


def meaning_digest(event: str | None, fields: dict[tuple, dict], tags: IdentityTags = DEFAULT_TAGS) -> str | None:
    body = meaning(event, fields)
    return None if body is None else hashlib.sha256(f"{tags.vocab}\0".encode() + body).hexdigest()


def canonical_number(column: Column) -> Column:
    """``-123e-2`` form of JSON numbers in text; null for other text."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            d = None if v is None else decimal(v)
            out.append(None if d is None else f"{'-' if d[0] else ''}{d[1]}e{d[2]}")
        return pd.Series(out, dtype=object)

    return run(column)


def revise(history: DataFrame, proposed: DataFrame) -> DataFrame:
    """Outcomes of proposed revisions (schema_id, sem_id, etag, reason) against the last of each schema (schema_id, revision, sem_id)."""
    last = history.groupBy("schema_id").agg(F.max_by("sem_id", "revision").alias("now"), F.max("revision").alias("at"))
    joined = proposed.join(last, "schema_id", "left")
    outcome = (
        F.when(F.col("now").isNull(), "first").when(F.col("sem_id") == F.col("now"), "already_active")
        .when(~F.col("etag").eqNullSafe(F.col("at")), "conflict").when(F.coalesce(F.btrim("reason"), F.lit("")) == "", "reason_required").otherwise("appended")
    )
    return joined.select("schema_id", "sem_id", outcome.alias("outcome"))
