"""Matrix scans over streams: the scan has no state, so hits above their thresholds go out with the batch they come in with, and
counts of hits in event-time windows are kept under a watermark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan


def scan_stream(stream: DataFrame, matrices: dict[int, np.ndarray], thresholds: dict[int, float]) -> DataFrame:
    """Hits of a stream of (seq_id, seq)."""
    return scan(stream, matrices, thresholds)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, key, n) of a stream, for data at most ``late`` behind."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
