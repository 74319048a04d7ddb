"""The Fourier transform of each slot's grid, a line at a time: rows, then columns, then rows back.

Three groupings by line carry the whole transform; what a task holds is one
batch of lines, never a grid.  Whether a coefficient stays is told by its own
magnitude, which is known once the columns are transformed, so they are
filtered and transformed back at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taper(size: np.ndarray, cutoff: float, width: float) -> np.ndarray:
    """The share kept of coefficients of these magnitudes: all below cutoff - width, none from cutoff + width on, between them half a sine."""
    if width == 0:
        return (size < cutoff).astype(float)
    return 0.5 * (1 - np.sin(np.pi * np.clip((size - cutoff) / (2 * width), -0.5, 0.5)))


def _lines(cells: DataFrame, line: str, place: str, length: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """t, line, place, re, im of every place, after `change` of the lines (rows of a complex matrix of this length); absent places count as 0."""
    held = cells.groupBy("t", line).agg(F.collect_list(place).alias("at"), F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("at", "re", "im")}
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(columns["at"])))
            at, re, im = (np.asarray(c.flatten()) for c in columns.values())
            grid = np.zeros((batch.num_rows, length), complex)
            grid[owner, at] = re + 1j * im
            grid = change(grid).reshape(-1)
            rows = np.repeat(np.arange(batch.num_rows), length)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in ("t", line)), pa.array(np.tile(np.arange(length, dtype=np.int32), batch.num_rows)), pa.array(grid.real), pa.array(grid.imag)],
                names=["t", line, place, "re", "im"],
            )

    return held.mapInArrow(run, f"t int, {line} int, {place} int, re double, im double")


def low_pass(cube: DataFrame, x: str, cutoff: float, shape: tuple[int, int], width: float = 0.0) -> DataFrame:
    """t, lat_i, lon_i, smooth: each slot's grid of `shape` cells with the Fourier coefficients that `taper` keeps.

    Coefficients are told by magnitude, not by frequency.  Missing values count
    as 0; cells outside the cube get their value too; a slot without any row
    has none, and neither has an empty cube.  Cells are expected once a slot;
    other columns are ignored.
    """
    if width < 0:
        raise ValueError("the taper's width is not negative")
    n_lat, n_lon = shape
    cells = cube.select("t", "lat_i", "lon_i", F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))

    def filtered(grid: np.ndarray) -> np.ndarray:
        f = np.fft.fft(grid, axis=1)
        return np.fft.ifft(f * taper(np.abs(f), cutoff, width), axis=1)

    rows = _lines(cells, "lat_i", "lon_i", n_lon, lambda grid: np.fft.fft(grid, axis=1))
    columns = _lines(rows, "lon_i", "lat_i", n_lat, filtered)
    back = _lines(columns, "lat_i", "lon_i", n_lon, lambda grid: np.fft.ifft(grid, axis=1))
    return back.select("t", "lat_i", "lon_i", F.col("re").alias("smooth"))
