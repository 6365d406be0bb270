"""Two-level partitioning of the sphere: stripes of chunks, sub-stripes of sub-chunks.

Stripes are latitude bands of equal height, cut into as many chunks as are at least as
wide as the band is high; each stripe has sub-stripes, and its chunks sub-chunks, by the
same rule. The arithmetic is given both for Python values (a plan's few regions) and as
column expressions (rows).
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spherical as S


def segments(lat_min: float, lat_max: float, width: float) -> int:
    """How many equal segments of longitude fit into a band when their narrow ends are at least `width` apart."""
    phi = max(abs(lat_min), abs(lat_max))
    if phi > 90 - 1 / 3600 or width >= 180:
        return 1
    c = math.cos(math.radians(phi)) ** 2
    x = math.cos(math.radians(width)) - math.sin(math.radians(phi)) ** 2
    y = math.sqrt(abs(c * c - x * x))
    return int(math.floor(360 / abs(math.degrees(math.atan2(y, x)))))


class Chunker:
    def __init__(self, stripes: int, sub_stripes: int, overlap: float = 0.0):
        if stripes < 1 or sub_stripes < 1:
            raise ValueError("there must be at least one stripe and sub-stripe")
        self.stripes, self.sub_stripes, self.overlap = stripes, sub_stripes, overlap
        self.height, self.sub_height = 180 / stripes, 180 / (stripes * sub_stripes)
        if not 0 <= overlap <= 10 or overlap > self.sub_height:
            raise ValueError("the overlap must be within 0 and 10 degrees and at most the height of a sub-stripe")
        edge = lambda k, h: min(90.0, -90 + k * h)
        self.chunks = [segments(edge(i, self.height), edge(i + 1, self.height), self.height) for i in range(stripes)]
        self.sub_chunks, self.width, self.alpha = [], [], []
        for k in range(stripes * sub_stripes):
            low, high = edge(k, self.sub_height), edge(k + 1, self.sub_height)
            nc = self.chunks[k // sub_stripes]
            n = max(1, segments(low, high, self.sub_height) // nc)
            self.sub_chunks.append(n)
            self.width.append(360 / (n * nc))
            self.alpha.append(S.max_alpha(overlap, max(abs(low), abs(high))))
            if overlap and self.alpha[-1] > self.width[-1] and nc * n > 1:
                raise ValueError("the overlap is wider than a sub-chunk")
        self.most = max(self.sub_chunks)

    @cached_property
    def all_chunks(self) -> list[int]:
        return [2 * self.stripes * s + c for s, n in enumerate(self.chunks) for c in range(n)]

    # ---- Python values

    def locate(self, lon: float, lat: float) -> tuple[int, int]:
        """(chunk, sub-chunk) of a position."""
        ss = min(int(math.floor((lat + 90) / self.sub_height)), self.stripes * self.sub_stripes - 1)
        stripe = ss // self.sub_stripes
        n = self.sub_chunks[ss]
        sc = min(int(math.floor((lon % 360) / self.width[ss])), self.chunks[stripe] * n - 1)
        return 2 * self.stripes * stripe + sc // n, self.most * (ss % self.sub_stripes) + sc % n

    def chunk_bounds(self, chunk: int) -> tuple[float, float, float, float]:
        """(lon min, lat min, lon max, lat max) of a chunk."""
        stripe, c = divmod(chunk, 2 * self.stripes)
        if not 0 <= stripe < self.stripes or c >= self.chunks[stripe]:
            raise ValueError(f"no chunk has the id {chunk}")
        w = 360 / self.chunks[stripe]
        return c * w, -90 + stripe * self.height, (c + 1) * w, min(90.0, -90 + (stripe + 1) * self.height)

    def sub_chunk_bounds(self, chunk: int, sub_chunk: int) -> tuple[float, float, float, float]:
        stripe, c = divmod(chunk, 2 * self.stripes)
        row, at = divmod(sub_chunk, self.most)
        ss = stripe * self.sub_stripes + row
        if row >= self.sub_stripes or at >= self.sub_chunks[ss]:
            raise ValueError(f"chunk {chunk} has no sub-chunk {sub_chunk}")
        k, w = c * self.sub_chunks[ss] + at, self.width[ss]
        return k * w, -90 + ss * self.sub_height, (k + 1) * w, min(90.0, -90 + (ss + 1) * self.sub_height)

    def sub_chunks_of(self, chunk: int) -> list[int]:
        stripe = chunk // (2 * self.stripes)
        return [self.most * r + k for r in range(self.sub_stripes) for k in range(self.sub_chunks[stripe * self.sub_stripes + r])]

    def chunks_in_box(self, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> list[int]:
        """Chunks that a box (which may wrap) touches."""
        out = []
        full = lon_max - lon_min >= 360
        low, high = lon_min % 360, lon_max % 360
        for s, n in enumerate(self.chunks):
            bottom, top = -90 + s * self.height, -90 + (s + 1) * self.height
            if top < lat_min or bottom > lat_max:
                continue
            w = 360 / n
            for c in range(n):
                a, b = c * w, (c + 1) * w
                if full or n == 1 or (a <= high and b >= low if low <= high else b >= low or a <= high) or (c == 0 and high == 0) or (c == n - 1 and low == 0):
                    out.append(2 * self.stripes * s + c)
        return out

    def chunks_of_node(self, node: int, nodes: int, box: tuple[float, float, float, float] | None = None) -> list[int]:
        """Chunks, of a box or of all, that fall to one of several nodes."""
        return [c for k, c in enumerate(self.chunks_in_box(*box) if box else self.all_chunks) if k % nodes == node]

    # ---- columns

    def _table(self, values: list, at: Column) -> Column:
        return F.element_at(F.lit(np.array(values)), (at + 1).cast("int"))

    def _sub_stripe(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / self.sub_height), F.lit(self.stripes * self.sub_stripes - 1)).cast("int")

    def _ids(self, ss: Column, sc: Column) -> tuple[Column, Column]:
        n = self._table(self.sub_chunks, ss)
        stripe = F.floor(ss / self.sub_stripes)
        return (2 * self.stripes * stripe + F.floor(sc / n)).cast("int"), (self.most * (ss % self.sub_stripes) + sc % n).cast("int")

    def columns(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(chunk, sub-chunk) of each row; null where a coordinate is."""
        ss = self._sub_stripe(lat)
        total = self._table([n * self.chunks[k // self.sub_stripes] for k, n in enumerate(self.sub_chunks)], ss)
        sc = F.least(F.floor(S.reduce_lon(lon) / self._table(self.width, ss)), total - 1)
        return self._ids(ss, sc)

    def overlap_cells(self, lon: Column, lat: Column) -> Column:
        """Array of (chunkId, subChunkId): the cells whose overlap region, but not whose own, holds each row."""
        at, home = S.reduce_lon(lon), self._sub_stripe(lat)
        last = self.stripes * self.sub_stripes - 1
        totals = [n * self.chunks[k // self.sub_stripes] for k, n in enumerate(self.sub_chunks)]

        def of(ss: Column) -> Column:
            w, alpha, total = self._table(self.width, ss), self._table(self.alpha, ss), self._table(totals, ss)
            bottom = -90 + ss * self.sub_height
            near = (lat >= bottom - self.overlap) & (lat <= bottom + self.sub_height + self.overlap)
            some = F.sequence(F.floor((at - alpha) / w), F.least(F.floor((at + alpha) / w), F.floor((at - alpha) / w) + total - 1))
            cells = F.array_distinct(F.transform(some, lambda k: F.pmod(k, total)))
            own = F.least(F.floor(at / w), total - 1)
            cells = F.filter(cells, lambda k: (ss != home) | (k != own))
            made = F.transform(cells, lambda k: F.struct(self._ids(ss, k)[0].alias("chunkId"), self._ids(ss, k)[1].alias("subChunkId")))
            return F.when(near, made).otherwise(F.array().cast("array<struct<chunkId:int,subChunkId:int>>"))

        rows = F.filter(F.array(home - 1, home, home + 1), lambda s: (s >= 0) & (s <= last))
        return F.flatten(F.transform(rows, of))
