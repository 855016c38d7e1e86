"""Fixed lat/lon grid: edges, cell of a point (D4), centres (D5), nearest centre.

The grid has ``size`` edges per axis, hence ``(size-1)**2`` cells numbered
``lat_idx * (size-1) + lon_idx``. Edges are computed once on the driver with
``numpy.linspace`` (50 constants) and enter the plan as double literals, so
Spark and any SQL oracle bin with bit-identical boundaries.

Cell assignment matches ``digitize(x, edges) - 1`` clipped to ``[0, size-2]``:
the number of edges ``<= x``, minus one, clipped. It is computed with an
arithmetic guess plus one exact comparison against each neighbouring edge
literal, which keeps the expression inside whole-stage codegen (no
higher-order function per row).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: 50 edges per axis over
# latitude 41.6..42.0 and longitude -87.9..-87.5.
DEFAULT_GRID_SIZE = 50
DEFAULT_LAT_RANGE = (41.6, 42.0)
DEFAULT_LON_RANGE = (-87.9, -87.5)


def _double_sql(v: float) -> str:
    v = float(v)
    if v != v or v in (float("inf"), float("-inf")):
        return f"cast('{'NaN' if v != v else ('Infinity' if v > 0 else '-Infinity')}' as double)"
    return f"{v!r}D"  # shortest round-trip text, parsed as a double (not a decimal)


def _lit_array(values) -> Column:
    """A constant array<double> built as one SQL expression (one JVM call, exact values)."""
    return F.expr("array(" + ", ".join(_double_sql(v) for v in values) + ")")


@dataclass(frozen=True)
class Grid:
    size: int = DEFAULT_GRID_SIZE
    lat_range: tuple = DEFAULT_LAT_RANGE
    lon_range: tuple = DEFAULT_LON_RANGE
    lat_edges: tuple = field(init=False)
    lon_edges: tuple = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "lat_edges", tuple(float(v) for v in np.linspace(*self.lat_range, self.size)))
        object.__setattr__(self, "lon_edges", tuple(float(v) for v in np.linspace(*self.lon_range, self.size)))

    @property
    def cells_per_axis(self) -> int:
        return self.size - 1

    @property
    def n_cells(self) -> int:
        return self.cells_per_axis ** 2

    @property
    def lat_centres(self) -> tuple:
        e = np.asarray(self.lat_edges)
        return tuple(float(v) for v in (e[:-1] + e[1:]) / 2)

    @property
    def lon_centres(self) -> tuple:
        e = np.asarray(self.lon_edges)
        return tuple(float(v) for v in (e[:-1] + e[1:]) / 2)

    # ---- D4 -------------------------------------------------------------
    def axis_index(self, x: Column, edges: tuple) -> Column:
        """digitize(x, edges) - 1, clipped to [0, size-2]. NULL or NaN in -> NULL out."""
        n = len(edges)
        lo, hi = edges[0], edges[-1]
        step = (hi - lo) / (n - 1)
        # edges padded with -inf/+inf: the neighbour lookups need no range guards
        padded = _lit_array([float("-inf"), *edges, float("inf")])
        # g = guess of #{edges <= x}, clipped into [0, n]; off by at most one near an edge
        # (clipped as a double first: a far point would overflow the integer)
        g = F.floor(F.least(F.greatest((x - F.lit(lo)) / F.lit(step), F.lit(-1.0)), F.lit(n - 1.0))).cast("int") + 1
        # exact fix-up: padded[g] is edges[g-1], padded[g+1] is edges[g] (0-based)
        cnt = (g - (F.element_at(padded, g + 1) > x).cast("int")
               + (F.element_at(padded, g + 2) <= x).cast("int"))
        # least/greatest skip NULLs, so a NULL x is guarded explicitly
        return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(cnt - 1, F.lit(0)), F.lit(n - 2)))

    def lat_index(self, lat: str | Column = "latitude") -> Column:
        return self.axis_index(F.col(lat) if isinstance(lat, str) else lat, self.lat_edges)

    def lon_index(self, lon: str | Column = "longitude") -> Column:
        return self.axis_index(F.col(lon) if isinstance(lon, str) else lon, self.lon_edges)

    def cell(self, lat: str | Column = "latitude", lon: str | Column = "longitude") -> Column:
        """Cell id ``lat_idx * (size-1) + lon_idx``."""
        return self.lat_index(lat) * self.cells_per_axis + self.lon_index(lon)

    # ---- D5 -------------------------------------------------------------
    def centre_lat(self, cell: str | Column = "cell") -> Column:
        c = F.col(cell) if isinstance(cell, str) else cell
        return F.element_at(_lit_array(self.lat_centres), F.floor(c / self.cells_per_axis).cast("int") + 1)

    def centre_lon(self, cell: str | Column = "cell") -> Column:
        c = F.col(cell) if isinstance(cell, str) else cell
        return F.element_at(_lit_array(self.lon_centres), F.pmod(c, F.lit(self.cells_per_axis)).cast("int") + 1)

    # ---- D12 ------------------------------------------------------------
    def _centre_candidates(self, x: Column, centres: tuple) -> tuple[Column, Column]:
        """The two centre indices bracketing x (0-based); the nearest is one of them."""
        m = len(centres)
        step = (centres[-1] - centres[0]) / (m - 1)
        a = F.floor(F.least(F.greatest((x - F.lit(centres[0])) / F.lit(step), F.lit(0.0)), F.lit(m - 1.0))).cast("int")
        b = F.least(a + 1, F.lit(m - 1))
        return a, b

    def nearest_centre(self, lat: str | Column = "latitude", lon: str | Column = "longitude") -> Column:
        """Cell whose centre is closest (Euclidean, degrees); ties -> lowest cell id.

        Distances separate per axis, so the nearest centre is among the 2x2
        candidates bracketing the point; the Euclidean distance is evaluated
        exactly for those four and the smallest (distance, cell) wins.
        """
        la = F.col(lat) if isinstance(lat, str) else lat
        lo = F.col(lon) if isinstance(lon, str) else lon
        lat_c, lon_c = _lit_array(self.lat_centres), _lit_array(self.lon_centres)
        ia, ib = self._centre_candidates(la, self.lat_centres)
        ja, jb = self._centre_candidates(lo, self.lon_centres)
        cands = []
        for i in (ia, ib):
            for j in (ja, jb):
                d = euclid(la, lo, F.element_at(lat_c, i + 1), F.element_at(lon_c, j + 1))
                cands.append(F.struct(d.alias("d"), (i * self.cells_per_axis + j).alias("cell")))
        present = la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)
        return F.when(present, F.least(*cands)["cell"])


DEFAULT_GRID = Grid()


def euclid(lat: Column, lon: Column, lat0, lon0) -> Column:
    """Euclidean distance in degrees, as ``sqrt(dlat^2 + dlon^2)``."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(float(lat0))
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    dlat, dlon = lat - lat0, lon - lon0
    return F.sqrt(dlat * dlat + dlon * dlon)
