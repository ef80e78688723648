"""Detector and scan geometry; fixed before a run and never taken from the stream."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ScanConfig:
    """Shapes are (rows, columns); the centre is (y, x) in detector pixels."""

    detector: tuple[int, int] = (192, 192)
    scan: tuple[int, int] = (1024, 1024)
    centre: tuple[float, float] = (96.0, 96.0)
    radius: float = 30.0
    frame_period_us: float = 33.30
    chunk_size: int = 128

    @property
    def positions(self) -> int:
        return self.scan[0] * self.scan[1]

    @property
    def pixels(self) -> int:
        return self.detector[0] * self.detector[1]

    @property
    def detector_rate_hz(self) -> float:
        """Frames a second at the detector's period; NaN if no period is given."""
        return 1e6 / self.frame_period_us if self.frame_period_us else float("nan")

    def with_(self, **changes) -> ScanConfig:
        return replace(self, **changes)


#: Presets: full detector and detector binned by two.
UNBINNED = ScanConfig()
BINNED = ScanConfig(detector=(96, 96), centre=(48.0, 48.0), radius=15.0, frame_period_us=8.33)
