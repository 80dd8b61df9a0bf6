"""Parameters of a correlation, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

MODES = ("linear", "cyclic")
NORMALIZATIONS = ("overlap", "global")
#: Fixed values of the status column.
STATUS = {"OK": 0, "MASKED": 1, "OUTLIER": 2, "LOW_CONF": 3, "OUT_OF_RANGE": 4}


def triple(value: int | tuple[int, int, int], what: str = "window") -> tuple[int, int, int]:
    """A cube's edge, or three edges, as three positive ints."""
    edges = (value,) * 3 if isinstance(value, int) else tuple(int(v) for v in value)
    if len(edges) != 3:
        raise ValueError(f"{what} needs three entries, got {value}")
    if min(edges) <= 0:
        raise ValueError(f"{what} must be positive, got {value}")
    return edges


@dataclass(frozen=True)
class Lattice:
    """Points of interest on a regular lattice: windows of a volume at a fixed stride, in C order over (z, y, x)."""

    shape: tuple[int, int, int]
    window: tuple[int, int, int] | int = 96
    overlap: float = 0.5
    stride: tuple[int, int, int] = field(init=False)
    counts: tuple[int, int, int] = field(init=False)

    def __post_init__(self):
        shape, window = triple(self.shape, "shape"), triple(self.window)
        if not 0 <= self.overlap < 1:
            raise ValueError(f"overlap must lie in [0, 1), got {self.overlap}")
        if any(w > s for w, s in zip(window, shape, strict=True)):
            raise ValueError(f"window {window} does not fit into {shape}")
        stride = tuple(max(1, round(w * (1 - self.overlap))) for w in window)
        counts = tuple((s - w) // d + 1 for s, w, d in zip(shape, window, stride, strict=True))
        for k, v in (("shape", shape), ("window", window), ("stride", stride), ("counts", counts)):
            object.__setattr__(self, k, v)

    @property
    def points(self) -> int:
        return prod(self.counts)


@dataclass(frozen=True)
class CorrelateConfig:
    window: tuple[int, int, int] | int = 96
    overlap: float = 0.5
    mask_threshold: float = 0.9
    mode: str = "linear"
    normalization: str = "overlap"
    search_radius: float | None = None
    tukey_alpha: float | None = None
    eps: float = 1e-12
    outlier_epsilon: float = 2.0
    noise_floor: float = 0.1
    min_neighbors: int = 4
    #: "single" transforms in 32 bits; sums and energies stay in 64.
    precision: str = "double"

    def __post_init__(self):
        object.__setattr__(self, "window", triple(self.window))
        if self.mode not in MODES or self.normalization not in NORMALIZATIONS:
            raise ValueError(f"unknown mode or normalization: {self.mode}, {self.normalization}")
        if self.mode == "cyclic" and self.normalization == "overlap":
            raise ValueError("cyclic correlation has no overlap normalization")
        if self.precision not in ("double", "single"):
            raise ValueError(f"unknown precision {self.precision}")
        if not 0 <= self.mask_threshold <= 1:
            raise ValueError(f"mask_threshold must lie in [0, 1], got {self.mask_threshold}")
        if self.eps <= 0 or self.outlier_epsilon <= 0 or self.noise_floor <= 0 or self.min_neighbors < 1:
            raise ValueError("eps, outlier_epsilon, noise_floor and min_neighbors must be positive")
        if self.tukey_alpha is not None and not 0 <= self.tukey_alpha <= 1:
            raise ValueError(f"tukey_alpha must lie in [0, 1], got {self.tukey_alpha}")
        if self.search_radius is not None and self.search_radius <= 0:
            raise ValueError(f"search_radius must be positive, got {self.search_radius}")

    @property
    def alpha(self) -> float:
        """The taper: none for linear correlation, a quarter for cyclic."""
        return self.tukey_alpha if self.tukey_alpha is not None else 0.0 if self.mode == "linear" else 0.25

    @property
    def radius(self) -> float:
        return self.search_radius if self.search_radius is not None else min(self.window) // 2
