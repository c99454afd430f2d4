"""Area means of arriving events, as an extension: nothing like it is required of the cubes.

The batch operators work on streams where they only filter, project and aggregate; this is
the form with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.operators.stats import weighted_mean


def windowed_means(events: DataFrame, x: str, w: str, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(window, by, mean, n); rows later than ``late`` are left out once their window is closed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    # a watermark needs a point in time, not a local one
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window, *by).agg(weighted_mean(F.col(x), F.col(w)).alias("mean"), F.count(x).alias("n"))
