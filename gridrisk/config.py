"""Parameters of models and studies."""

from __future__ import annotations

from dataclasses import dataclass


class MissingColumns(ValueError):
    """A source lacks columns that it must have."""


class NotForward(ValueError):
    """A forecast's target isn't after what it was trained on."""


class NotPublished(ValueError):
    """Realised data don't reach the target month."""


@dataclass(frozen=True)
class BoundingBox:
    """Inclusive limits in metres."""

    east_low: float = 500_000
    east_high: float = 565_000
    north_low: float = 155_000
    north_high: float = 205_000


@dataclass(frozen=True)
class ModelConfig:
    """n draws (200 if not positive), seed, the last hist_k months present (0: all), shrink (0 means 1), radius of the spatial
    prior (0: the overall rate), ar for an AR(1) factor."""

    n: int = 400
    seed: int = 1
    hist_k: int = 0
    shrink: float = 0.0
    radius: int = 0
    ar: bool = False

    @property
    def draws(self) -> int:
        return self.n if self.n > 0 else 200

    @property
    def weight(self) -> float:
        return self.shrink or 1.0

    @property
    def name(self) -> str:
        spatial = f"+sp(r{self.radius},a{self.shrink:g})" if self.radius > 0 else ""
        return f"poisson-factor{spatial}{'+ar1' if self.ar else ''}"


#: The published tiers: all incidents, and the killed or seriously injured.
TIERS = {"accidents": ModelConfig(ar=True), "ksi": ModelConfig(ar=True, radius=2, shrink=20)}
