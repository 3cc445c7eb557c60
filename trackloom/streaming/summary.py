"""Track summaries over unbounded detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(spots: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, uid, n_spots, mean_x, mean_y, extent_x, extent_y) by event time; state is dropped behind the watermark."""
    by = spots.withWatermark(time, late).groupBy(F.window(time, width), "uid")
    return by.agg(F.count("*").alias("n_spots"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), (F.max("x") - F.min("x")).alias("extent_x"), (F.max("y") - F.min("y")).alias("extent_y"))
