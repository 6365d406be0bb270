"""Area restrictors: argument checks, row tests, and the chunks that a region can touch."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import spherical as S
from ..functions.box import SphericalBox
from ..operators.chunker import Chunker

_COUNTS = {"box": 4, "circle": 3, "ellipse": 5}


def check(kind: str, args: tuple) -> None:
    wrong = len(args) != _COUNTS[kind] if kind in _COUNTS else len(args) < 6 or len(args) % 2
    if wrong:
        raise AnalysisError(f"Wrong number of arguments for areaspec_{kind}")
    if kind == "box" and args[1] > args[3]:
        raise AnalysisError("areaspec_box: the smallest latitude is larger than the largest")
    if (kind == "circle" and args[2] < 0) or (kind == "ellipse" and not 0 <= args[3] <= args[2]):
        raise AnalysisError(f"areaspec_{kind}: radius or axes are out of range")


def test(kind: str, args: tuple, lon: Column, lat: Column) -> Column:
    """Whether a position lies in the region."""
    if kind == "poly":
        return S.in_polygon(lon, lat, list(zip(args[::2], args[1::2], strict=True))) == 1
    build = {"box": S.in_box, "circle": S.in_circle, "ellipse": S.in_ellipse}[kind]
    return build(lon, lat, *[F.lit(float(a)) for a in args]) == 1


def bounds(kind: str, args: tuple) -> tuple[float, float, float, float]:
    """A box that holds the region."""
    if kind == "box":
        return args
    if kind == "circle":
        return _around(args[0], args[1], args[2])
    if kind == "ellipse":
        return _around(args[0], args[1], args[2] / 3600)
    corners = [S._vec(x, y) for x, y in zip(args[::2], args[1::2], strict=True)]
    x, y, z = (sum(c) for c in zip(*corners, strict=True))
    size = math.sqrt(x * x + y * y + z * z) or 1.0
    lon, lat = math.degrees(math.atan2(y, x)) % 360, math.degrees(math.asin(max(-1, min(1, z / size))))
    far = max(math.degrees(math.acos(max(-1, min(1, (x * a + y * b + z * c) / size)))) for a, b, c in corners)
    return _around(lon, lat, far)


def _around(lon: float, lat: float, radius: float) -> tuple[float, float, float, float]:
    return SphericalBox(lon, lat, lon, lat).expand(radius).bounds


def chunks(kind: str, args: tuple, chunker: Chunker, margin: float = 0.0) -> list[int]:
    """Chunks that the region, or places within a margin of it, can touch (a few more than they do, never fewer)."""
    box = bounds(kind, args)
    return chunker.chunks_in_box(*(SphericalBox(*box).expand(margin).bounds if margin else box))
