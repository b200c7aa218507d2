"""Coordinates: equal-area projection, square cells, box tests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Spherical Albers equal-area conic (Snyder 1987), degrees in, metres out."""

    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 37.5
    lon0: float = -96.0
    radius: float = 6371007.181

    def constants(self) -> tuple[float, float, float]:
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        n = (math.sin(p1) + math.sin(p2)) / 2
        c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
        rho0 = self.radius * math.sqrt(c - 2 * n * math.sin(p0)) / n
        return n, c, rho0

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self.constants()
        rho = F.sqrt(c - 2 * n * F.sin(F.radians(lat))) * (self.radius / n)
        theta = F.radians(lon - self.lon0) * n
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def require_same_crs(*systems: Albers) -> Albers:
    """The common coordinate system of several tables; differing ones are an error."""
    if len(set(systems)) != 1:
        raise ValueError(f"coordinate systems differ: {set(systems)}")
    return systems[0]


@dataclass(frozen=True)
class Grid:
    """Square cells of ``size`` from the corner ``(x0, y0)``, ``nx`` to a row."""

    x0: float
    y0: float
    size: float
    nx: int
    ny: int

    def ix(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.size)

    def iy(self, y: Column) -> Column:
        return F.floor((y - self.y0) / self.size)

    def cell_of(self, ix: Column, iy: Column) -> Column:
        """Cell number, counted along x first; NULL outside the grid."""
        inside = (ix >= 0) & (ix < self.nx) & (iy >= 0) & (iy < self.ny)
        return F.when(inside, iy * self.nx + ix)

    def cell(self, x: Column, y: Column) -> Column:
        return self.cell_of(self.ix(x), self.iy(y))

    def centre_x(self, cell: Column) -> Column:
        return self.x0 + (cell % self.nx + 0.5) * self.size

    def centre_y(self, cell: Column) -> Column:
        return self.y0 + (F.floor(cell / self.nx) + 0.5) * self.size


def in_box(x: Column, y: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    return x.between(xmin, xmax) & y.between(ymin, ymax)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)
