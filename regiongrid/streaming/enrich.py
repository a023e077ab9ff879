"""Reverse geocoding of a stream: the batch plan, map-only, on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import reverse as _reverse
from ..plans.registry import RegionRegistry


def enrich(points: DataFrame, registry: RegionRegistry) -> DataFrame:
    """A streaming frame of points with province, city and district.

    Stream-static left joins without state: any output mode, no watermark needed.
    """
    return _reverse.reverse(points, registry)


def write_enriched(points: DataFrame, registry: RegionRegistry, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that hands each enriched micro-batch and its number to ``sink``."""
    return (
        points.writeStream.foreachBatch(lambda batch, n: sink(enrich(batch, registry), n))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
