"""Boxes in longitude and latitude, which may wrap around the meridian of 0 degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from . import spherical as S


@dataclass(frozen=True)
class SphericalBox:
    """Longitudes from lon_min eastwards to lon_max, and latitudes between two bounds, in degrees; bounds belong to the box."""

    lon_min: float
    lat_min: float
    lon_max: float
    lat_max: float

    def __post_init__(self) -> None:
        if self.lat_min > self.lat_max:
            raise ValueError("the smallest latitude is larger than the largest")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.lon_min, self.lat_min, self.lon_max, self.lat_max

    @property
    def extent(self) -> float:
        """Degrees of longitude that the box spans."""
        d = self.lon_max - self.lon_min
        return 360.0 if d >= 360 else d % 360

    @property
    def area(self) -> float:
        """Square degrees."""
        low, high = (math.sin(math.radians(max(-90.0, min(90.0, x)))) for x in (self.lat_min, self.lat_max))
        return self.extent * math.degrees(high - low)

    def expand(self, radius: float) -> SphericalBox:
        """A box that holds every place within a radius of this one."""
        if radius < 0:
            raise ValueError("a box does not grow by a negative angle")
        if not radius:
            return self
        low, high = max(-90.0, self.lat_min - radius), min(90.0, self.lat_max + radius)
        half = S.max_alpha(min(radius, 90.0), max(abs(self.lat_min), abs(self.lat_max))) if radius < 90 else 180.0
        if self.extent + 2 * half >= 360 - 1 / 3600:
            return SphericalBox(0.0, low, 360.0, high)
        return SphericalBox((self.lon_min - half) % 360, low, (self.lon_min + self.extent + half) % 360, high)

    def contains(self, lon: float, lat: float) -> bool:
        return self.lat_min <= lat <= self.lat_max and (lon - self.lon_min) % 360 <= self.extent

    def intersects(self, other: SphericalBox) -> bool:
        if self.lat_min > other.lat_max or self.lat_max < other.lat_min:
            return False
        return (other.lon_min - self.lon_min) % 360 <= self.extent or (self.lon_min - other.lon_min) % 360 <= other.extent
