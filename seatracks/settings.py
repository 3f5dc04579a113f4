"""Settings of the track jobs, with the usual defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    tracks: int = 1000
    geohash_precision: int = 7
    gap_sizes: tuple[int, ...] = (5, 10, 15, 30, 45, 60)
    prefix_steps: int = 60
    suffix_steps: int = 60
    train_windows: int = 3
    train_size: int = 800
    val_size: int = 100
    test_size: int = 100
    sog_variant: str = "S1"
    cog_variant: str = "C2"
    minutes_per_step: int = 10
    analysis_gaps: tuple[int, ...] = (5, 10, 30, 45)

    def required(self, gap: int) -> int:
        return self.prefix_steps + gap + self.suffix_steps


DEFAULTS = Settings()
