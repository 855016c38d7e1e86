"""Grid expressions as SQL text (DuckDB dialect) for the oracles: brute force."""

from __future__ import annotations

from ..functions.grid import DEFAULT_GRID, Grid
from .registry import dbl


def _list(values) -> str:
    return "[" + ", ".join(dbl(v) for v in values) + "]"


def axis_sql(x: str, edges) -> str:
    n = len(edges)
    return f"greatest(0, least({n - 2}, len(list_filter({_list(edges)}, lambda e: e <= {x})) - 1))"


def cell_sql(lat: str = "latitude", lon: str = "longitude", grid: Grid = DEFAULT_GRID) -> str:
    return f"({axis_sql(lat, grid.lat_edges)} * {grid.cells_per_axis} + {axis_sql(lon, grid.lon_edges)})"


def centres_cte(grid: Grid = DEFAULT_GRID) -> str:
    """``centres(cell, lat_c, lon_c)`` for every cell."""
    k = grid.cells_per_axis
    return (f"centres as (select cast(i as bigint) as cell, "
            f"{_list(grid.lat_centres)}[cast(floor(i / {k}) as bigint) + 1] as lat_c, "
            f"{_list(grid.lon_centres)}[cast(i % {k} as bigint) + 1] as lon_c "
            f"from range({grid.n_cells}) t(i))")
