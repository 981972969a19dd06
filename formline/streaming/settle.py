"""Settled sources: after a run of one known schema, only every n-th record is classified in full. Off unless asked for: a settled source also skips quarantine."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Settling:
    """What is known of a source while its records pass in order."""

    after: int
    every: int
    last: str | None = None
    run: int = 0
    since: int = 0

    def take(self, fate: str, schema_id: str | None) -> bool:
        """Whether a record is classified in full; a surprise unsettles."""
        if self.run >= self.after and self.since + 1 < self.every:
            self.since += 1
            return False
        self.since = 0
        if fate == "known" and schema_id == self.last:
            self.run += 1
        else:
            self.last, self.run = (schema_id, 1) if fate == "known" else (None, 0)
        return True


def fold(fates: list[str], ids: list[str | None], after: int, every: int) -> list[bool]:
    """Whether each record, in order, is classified in full."""
    now = Settling(after, every)
    return [now.take(f, i) for f, i in zip(fates, ids, strict=True)]


def settled(classified: DataFrame, after: int = 100, every: int = 50) -> DataFrame:
    """(source, seq, full) of classified records (source, seq, fate, schema_id): the order of a source decides, so each is folded by itself, by day at most."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame({"source": key[0], "seq": pdf["seq"], "full": fold(list(pdf["fate"]), list(pdf["schema_id"]), after, every)})

    return classified.groupBy("source", "part").applyInPandas(run, "source string, seq long, full boolean")
