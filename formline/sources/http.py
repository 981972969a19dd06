"""Rules that a table of ingest requests is filtered by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rejection(lengths: Column, chunked: Column, n_headers: Column, header_bytes: Column, max_body: int = 1 << 20, max_headers: int = 64, max_header_bytes: int = 16 << 10) -> Column:
    """The status of a request that is refused, null if it is taken; ``lengths`` are its Content-Length headers."""
    sizes = F.transform(lengths, lambda x: x.try_cast("long"))
    return (
        F.when(F.size(lengths) > 1, 400).when((F.size(lengths) == 1) & chunked, 400)
        .when(F.exists(sizes, lambda x: x.isNull() | (x < 0)), 400).when(F.exists(sizes, lambda x: x > max_body), 413)
        .when((n_headers > max_headers) | (header_bytes > max_header_bytes), 431)
    )
