"""Streams with state of a source: the novelty limit and settling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .settle import Settling


def novelty_stream(candidates: DataFrame, per_minute: int = 10) -> DataFrame:
    """(source, candidate, admitted) of a stream of new candidates (source, candidate, first_seen in ms): the first few of each minute.

    State is the minute and its count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        minute, n = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["first_seen", "candidate"], ignore_index=True)
        out = []
        for at in rows["first_seen"] // 60_000:
            minute, n = (minute, n + 1) if at <= minute else (int(at), 1)
            out.append(n <= per_minute)
        state.update((int(minute), int(n)))
        yield pd.DataFrame({"source": key[0], "candidate": rows["candidate"], "admitted": out})

    return candidates.groupBy("source").applyInPandasWithState(step, "source string, candidate string, admitted boolean", "minute long, n long", "append", GroupStateTimeout.NoTimeout)


def settled_stream(classified: DataFrame, after: int = 100, every: int = 50) -> DataFrame:
    """(source, seq, full) of a stream of (source, seq, fate, schema_id); state is the last schema, its run, and records since the last full look."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Settling(after, every, *(state.get if state.exists else (None, 0, 0)))
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", ignore_index=True)
        full = [now.take(f, None if pd.isna(i) else i) for f, i in zip(rows["fate"], rows["schema_id"], strict=True)]
        state.update((now.last, now.run, now.since))
        yield pd.DataFrame({"source": key[0], "seq": rows["seq"], "full": full})

    return classified.groupBy("source").applyInPandasWithState(step, "source string, seq long, full boolean", "last string, run long, since long", "append", GroupStateTimeout.NoTimeout)
