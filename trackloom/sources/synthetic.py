"""Synthetic detections: correlated random walks with pauses, for trials and tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Speed, turning and share of pauses of the presets.
PRESETS = {"fast": (4.0, 0.15, 0.05), "slow": (1.5, 0.3, 0.15), "straight": (3.0, 0.05, 0.02), "wander": (2.5, 0.8, 0.3)}


def walks(spark: SparkSession, preset: str, tracks: int = 18, frames: int = 320, field: float = 1024.0, seed: int = 0) -> DataFrame:
    """track, x, y, t, area, major, minor, angle, intensity_mean, intensity_std, diameter; a track is a row of the range
    that makes them, so any number of tracks is made in parallel."""
    speed, turning, pausing = PRESETS[preset]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                r = np.random.default_rng([seed, k])
                heading = r.uniform(0, 2 * np.pi) + np.cumsum(r.normal(0, turning, frames))
                step = np.where(r.random(frames) < pausing, 0.0, r.gamma(4, speed / 4, frames))
                x = np.mod(r.uniform(0, field) + np.cumsum(step * np.cos(heading)), field)
                y = np.mod(r.uniform(0, field) + np.cumsum(step * np.sin(heading)), field)
                major, minor = r.normal(20, 1, frames), r.normal(8, 0.5, frames)
                yield pa.RecordBatch.from_pydict({"track": [f"{k}"] * frames, "x": x, "y": y, "t": np.arange(frames, dtype=float), "area": np.pi / 4 * major * minor, "major": major, "minor": minor, "angle": np.degrees(heading) % 180, "intensity_mean": r.normal(120, 10, frames), "intensity_std": r.normal(15, 2, frames), "diameter": np.sqrt(major * minor)})

    columns = "track string, " + ", ".join(f"{c} double" for c in ("x", "y", "t", "area", "major", "minor", "angle", "intensity_mean", "intensity_std", "diameter"))
    return spark.range(tracks).mapInArrow(run, columns)
