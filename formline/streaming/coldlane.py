"""Clustering of unknown shapes with state: the first fingerprint seen decides, per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import fold

OUT = "source string, seq long, cluster string"
STATE = "fps array<string>, clusters array<string>"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = dict(zip(*state.get, strict=True)) if state.exists else {}
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    # What is known comes first, one fingerprint at a time, and so keeps its cluster.
    fps = [[f] for f in known] + [list(x) for x in rows["fps"]]
    clusters = fold(fps, [*known.values(), *rows["id"]])
    for f, c in zip(fps, clusters, strict=True):
        known.update(dict.fromkeys(f, c))
    state.update((list(known), list(known.values())))
    yield pd.DataFrame({"source": key[0], "seq": rows["seq"].to_numpy(), "cluster": clusters[len(fps) - len(rows) :]})


def cluster_stream(observations: DataFrame) -> DataFrame:
    """(source, seq, cluster) of a stream of (source, seq, id, fps); state holds a source's fingerprints."""
    return observations.groupBy("source").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
