"""Speed and course tokens.

Edges and names that no public description fixes are declared here, in one place, and can be replaced
by passing other bins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# End labels, thresholds and numbering of the variants.
COMPASS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
COMPASS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Variants of speed bins with fitted cut points: number of quantile bins.
QUANTILE_BINS = {"S2": 12, "S3": 16}


@dataclass(frozen=True)
class SpeedBins:
    """Labels of the bins below, between and above the edges; a lower edge belongs to its bin."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.labels) != len(self.edges) + 1 or list(self.edges) != sorted(self.edges):
            raise ValueError("bins need ascending edges and one label more")


S0 = SpeedBins((0.5, 5.0, 12.0, 20.0), ("STOP", "LOW", "MOD", "HIGH", "VHIGH"))
# Declared: inner edges and names.
S1 = SpeedBins(
    (0.5, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0),
    tuple(f"<SOG_{i:02d}_{name}>" for i, name in enumerate(("STOP", "DRIFT", "CREEP", "SLOW", "EASY", "MOD", "CRUISE", "BRISK", "FAST", "VFAST"))),
)
# Declared: the fixed bins below the fitted ones.
FIXED_EDGES = (0.5, 1.0, 2.0, 4.0)
FIXED_LABELS = tuple(f"<SOG_{i:02d}_{name}>" for i, name in enumerate(("STOP", "DRIFT", "CREEP", "SLOW")))


def quantile_bins(variant: str, cuts: list[float]) -> SpeedBins:
    """The hybrid bins of S2 or S3 from fitted cut points (ascending, one fewer than quantile bins)."""
    n = QUANTILE_BINS[variant]
    if len(cuts) != n - 1:
        raise ValueError(f"{variant} needs {n - 1} cut points")
    return SpeedBins((*FIXED_EDGES, *cuts), (*FIXED_LABELS, *(f"<SOG_{3 + i:02d}_Q{i:02d}>" for i in range(1, n + 1))))


def speed_bins(variant: str, cuts: list[float] | None = None) -> SpeedBins:
    if variant in QUANTILE_BINS:
        if cuts is None:
            raise ValueError(f"{variant} needs fitted cut points")
        return quantile_bins(variant, cuts)
    return {"S0": S0, "S1": S1}[variant]


def sog_token(sog: Column, bins: SpeedBins) -> Column:
    """Token of a speed in knots; null for a null, NaN or negative speed."""
    sog = sog.cast("double")
    chain = F.when(sog.isNull() | F.isnan(sog) | (sog < 0), F.lit(None).cast("string"))
    for edge, label in zip(bins.edges, bins.labels):
        chain = chain.when(sog < F.lit(float(edge)), F.lit(label))
    return chain.otherwise(F.lit(bins.labels[-1]))


def cog_normalize(cog: Column) -> Column:
    """Course in 0 to under 360 degrees."""
    return F.pmod(cog.cast("double"), F.lit(360.0))


def cog_labels(variant: str) -> tuple[str, ...]:
    if variant in ("C0", "C1"):
        return COMPASS_8 if variant == "C0" else COMPASS_16
    width = {"C2": 15, "C3": 10}[variant]
    return tuple(f"<COG_{d:03d}>" for d in range(0, 360, width))


def cog_token(cog: Column, variant: str = "C2", centred: bool | None = None) -> Column:
    """Token of a course; compass points sit in the middle of their sector, numbered bins start at their label
    (declared; ``centred`` overrides it). Null for null and NaN."""
    labels = cog_labels(variant)
    width = 360.0 / len(labels)
    if centred is None:
        centred = variant in ("C0", "C1")
    turned = F.pmod(cog_normalize(cog) + F.lit(width / 2 if centred else 0.0), F.lit(360.0))
    at = F.floor(turned / F.lit(width)).cast("int")
    return F.when(cog.isNotNull() & ~F.isnan(cog.cast("double")), F.element_at(F.expr("array(" + ", ".join(f"'{x}'" for x in labels) + ")"), at + 1))
