"""Map projection and planar geometry as column expressions.

Conus Albers equal-area (EPSG:5070) after Snyder, *Map Projections: A Working
Manual* (1987): the cone constants are folded on the driver, the rest is plain
SQL arithmetic over the two columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketgrid.functions.columns import METRES_PER_MILE, Col, col


@dataclass(frozen=True)
class Albers:
    """An ellipsoidal Albers cone; the defaults are EPSG:5070 on GRS80."""

    a: float = 6378137.0
    e2: float = (1 / 298.257222101) * (2 - 1 / 298.257222101)
    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    def _q(self, lat: float) -> float:
        s = math.sin(lat)
        return (1 - self.e2) * (
            s / (1 - self.e2 * s * s) - math.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e)
        )

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - self.e2 * math.sin(lat) ** 2)

    def cone(self) -> tuple[float, float, float]:
        """(n, C, rho0)"""
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        n = (self._m(p1) ** 2 - self._m(p2) ** 2) / (self._q(p2) - self._q(p1))
        c = self._m(p1) ** 2 + n * self._q(p1)
        return n, c, self.a * math.sqrt(c - n * self._q(p0)) / n

    def forward(self, lon: str, lat: str) -> tuple[Column, Column]:
        """Projected (x, y) of two degree columns, given as SQL expressions."""
        n, c, rho0 = self.cone()
        s = f"sin(radians({lat}))"
        q = (
            f"{1 - self.e2!r}D * ({s} / (1D - {self.e2!r}D * {s} * {s})"
            f" - ln((1D - {self.e!r}D * {s}) / (1D + {self.e!r}D * {s})) / {2 * self.e!r}D)"
        )
        rho = f"({self.a!r}D * sqrt({c!r}D - {n!r}D * {q}) / {n!r}D)"
        theta = f"({n!r}D * radians({lon} - {self.lon0!r}D))"
        return F.expr(f"{rho} * sin{theta}"), F.expr(f"{rho0!r}D - {rho} * cos{theta}")

    def inverse(self, x: str, y: str) -> tuple[Column, Column]:
        """(lon, lat) from projected metres, by the authalic-latitude series."""
        n, c, rho0 = self.cone()
        dy = f"({rho0!r}D - {y})"
        rho = f"sqrt({x} * {x} + {dy} * {dy}) * {n / self.a!r}D"
        qp = 1 - (1 - self.e2) / (2 * self.e) * math.log((1 - self.e) / (1 + self.e))
        beta = f"asin(({c!r}D - pow({rho}, 2D)) / {n * qp!r}D)"
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        lat = (
            f"degrees({beta} + {e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040!r}D * sin(2D * {beta})"
            f" + {23 * e4 / 360 + 251 * e6 / 3780!r}D * sin(4D * {beta})"
            f" + {761 * e6 / 45360!r}D * sin(6D * {beta}))"
        )
        return F.expr(f"{self.lon0!r}D + degrees(atan2({x}, {dy}) / {n!r}D)"), F.expr(lat)


CONUS = Albers()


def with_xy(df, lon: str, lat: str, x: str = "x", y: str = "y"):
    """Add projected metres; rows without coordinates keep NULLs."""
    px, py = CONUS.forward(lon, lat)
    return df.withColumns({x: px, y: py})


def miles(ax: Col, ay: Col, bx: Col, by: Col) -> Column:
    """Planar distance in statute miles between two projected points."""
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy) / F.lit(METRES_PER_MILE)
