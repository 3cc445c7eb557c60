"""Parameters of the operators, and their JSON form."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field


@dataclass
class TrackConfig:
    """How detections become tracks. Lengths are coordinates times pixel_size, times are frames times frame_interval,
    unless the columns are calibrated already."""

    pixel_size: float = 1.0
    frame_interval: float = 0.1
    length_unit: str = "um"
    time_unit: str = "s"
    coords_are_calibrated: bool = False
    times_are_calibrated: bool = False
    min_spots: int = 20
    edge_margin: float = 0.0
    image_width: float = 0.0
    image_height: float = 0.0
    trim: float = 0.6
    halt_threshold_px: float = 1.5
    auto_halt: bool = True
    msd_fraction: float = 0.25
    smoothing_window: int = 0

    @property
    def scale(self) -> float:
        return 1.0 if self.coords_are_calibrated else self.pixel_size

    @property
    def time_scale(self) -> float:
        return 1.0 if self.times_are_calibrated else self.frame_interval


@dataclass
class PrepareConfig:
    scaler: str = "zscore"
    missing: str = "impute_median"
    drop_constant: bool = True
    max_correlation: float = 0.98
    winsorise: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)


@dataclass
class SomConfig:
    algorithm: str = "batch"
    width: int = 0
    height: int = 0
    topology: str = "hex"
    toroidal: bool = False
    init: str = "pca"
    neighbourhood: str = "gaussian"
    epochs: int = 200
    learning_rate: float = 0.5
    decay: float = 0.25
    sigma_final: float = 0.7
    seed: int = 0
    label_weight: float = 0.35
    relevance_rate: float = 0.02
    relevance_floor: float = 0.05
    spread: float = 0.5
    max_nodes: int = 400

    def size(self, n: int) -> tuple[int, int]:
        """Width and height; by default five nodes for each root of n, wider than high, and 4 by 3 at least."""
        if self.width and self.height:
            return self.width, self.height
        target = max(9.0, 5.0 * n**0.5)
        h = max(3, round((0.75 * target) ** 0.5))
        return max(4, round(target / h)), h


@dataclass
class StatsConfig:
    metric: str = "euclidean"
    permutations: int = 999
    model: str = "lda_shrinkage"
    folds: int = 5
    repeats: int = 5
    bootstrap: int = 5000
    alpha: float = 0.05
    cluster_threshold: float = 0.7
    seed: int = 0


@dataclass
class Config:
    track: TrackConfig = field(default_factory=TrackConfig)
    prepare: PrepareConfig = field(default_factory=PrepareConfig)
    som: SomConfig = field(default_factory=SomConfig)
    stats: StatsConfig = field(default_factory=StatsConfig)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Keys that are not known are passed over."""
        data, out = json.loads(text), cls()
        for section in dataclasses.fields(cls):
            part = getattr(out, section.name)
            for f in dataclasses.fields(part):
                if f.name in data.get(section.name, {}):
                    setattr(part, f.name, data[section.name][f.name])
        return out
