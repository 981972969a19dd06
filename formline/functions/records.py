"""Columns from JSON records: the strict parser as an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import shapes
from .strictjson import Limits, Rejected, parse

PARSED = "reason string, canonical string, n_fields int, depth int, keys array<string>"
OCCURRENCE = "path string, parent string, kind int, empty boolean, partial boolean, whole boolean, minus_zero boolean, mask int"


def parser(limits: Limits = Limits()):
    """A function of binary or string: the reason of a rejection, or the shape and its summary."""

    @F.pandas_udf(PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[shapes.Shape, tuple] = {}
        for values in batches:
            rows = []
            for v in values:
                if v is None:
                    rows.append((None,) * 5)
                    continue
                try:
                    s = shapes.shape_of(parse(v.encode() if isinstance(v, str) else bytes(v), limits))
                except Rejected as e:
                    rows.append((e.reason, None, None, None, None))
                    continue
                if s not in memo:
                    if len(memo) > 10_000:
                        memo.clear()
                    keys = shapes.top_keys(s)
                    memo[s] = (None, shapes.canonical(s), len(keys), shapes.depth(s), keys)
                rows.append(memo[s])
            yield pd.DataFrame(rows, columns=["reason", "canonical", "n_fields", "depth", "keys"]).astype({"n_fields": "Int32", "depth": "Int32"})

    return parsed


def parse_records(records: DataFrame, value: str = "value", limits: Limits = Limits()) -> DataFrame:
    """``records`` with the columns of ``PARSED``. Oversized values never reach Python."""
    ship(records.sparkSession)
    v: Column = F.col(value)
    size = F.octet_length(v)
    small = F.when(size <= limits.max_bytes, v)
    out = records.withColumn("__p", parser(limits)(small))
    reason = F.when(size > limits.max_bytes, F.lit("size_exceeded")).otherwise(F.col("__p.reason"))
    return out.select(*records.columns, reason.alias("reason"), *[F.col(f"__p.{c}") for c in ("canonical", "n_fields", "depth", "keys")])


def observer(limits: Limits = Limits()):
    """A function of binary or string: one entry per node; null for what is no document."""

    @F.pandas_udf(f"array<struct<{', '.join(':'.join(x.split()) for x in OCCURRENCE.split(', '))}>>")
    def observed(values: pd.Series) -> pd.Series:
        names = [x.split()[0] for x in OCCURRENCE.split(", ")]
        out = []
        for v in values:
            try:
                node = None if v is None else parse(v.encode() if isinstance(v, str) else bytes(v), limits)
                out.append(None if v is None else [dict(zip(names, o, strict=True)) for o in shapes.occurrences(node)])
            except Rejected:
                out.append(None)
        return pd.Series(out, dtype=object)

    return observed


def observe(records: DataFrame, *keep: str, value: str = "value", limits: Limits = Limits()) -> DataFrame:
    """One row per node of every document that parses: the columns in ``keep`` and those of ``OCCURRENCE``."""
    ship(records.sparkSession)
    return records.select(*keep, F.explode(observer(limits)(F.col(value))).alias("o")).select(*keep, "o.*")
