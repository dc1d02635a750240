"""Mappings over streams.

A mapping is row-local, so the same plan runs on ``readStream`` in append mode without state.
Blank nodes need a key column (``row_id``), because rows of a stream have no numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.api import Mapping


def stream_triples(mapping: Mapping, stream: DataFrame, row_id: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Triples of a streaming DataFrame.

    ``watermark`` is (event-time column, delay): then each triple comes once within the delay, and the
    state is bounded by it; without it, each row's triples come once.
    """
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is expected")
    if watermark is None:
        return mapping.triples(stream, row_id=row_id)
    column, delay = watermark
    from graphloom.operators.run import triples_with

    timed = stream.withWatermark(column, delay)
    out = triples_with(mapping.plan, timed, row_id, column)
    return out.dropDuplicatesWithinWatermark(["subject", "predicate", "object"]).select("subject", "predicate", "object")
