"""Label rasters, one file a slot, as a Spark data source.

A file is named `YYYYMMDDHHMM00-<KIND><suffix>` by its slot's day and time and
holds one array (`.npy`), latitudes from north to south.  A partition is a
file; a day and slot range, given as options or as filters of the query, is
compared with the names alone, so other files are not opened.  Files of other
kinds and names are passed over.

Kinds: CSP (probability of a clear sky), CT (cloud type), CLS (another
algorithm's classes).  A value that means missing becomes null or, with
`holes` = "keep", the label of a hole; a slot whose file is missing or can't be
read is a hole in every cell of the window ("keep") or gives no rows
("remove").

    spark.dataSource.register(SlotFiles)
    spark.read.format("slotfiles").options(path=…, kind="CSP", first_day=16071, last_day=16073).load()
"""

from __future__ import annotations

import datetime
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

# fixed values: cells a degree and northern edge of the label grids, what stands for a hole, and for a missing class
CELLS_A_DEGREE, NORTH, HOLE, MISSING = 33, 60.0, -10.0, {"CLS": -99.0}
KINDS = ("CSP", "CT", "CLS")
SUFFIX = "_LATLON.npy"
_NAME = re.compile(r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})00-([A-Z]+)(.*)$")
_ORIGIN = datetime.date(1980, 1, 1)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI."""
    return fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:") and not path.startswith("file://") else path)


def file_name(dfb: int, slot: int, kind: str, slots_per_day: int, suffix: str = SUFFIX) -> str:
    minutes = 1440 // slots_per_day * slot
    day = _ORIGIN + datetime.timedelta(days=dfb)
    return f"{day:%Y%m%d}{minutes // 60:02d}{minutes % 60:02d}00-{kind}{suffix}"


def parse_name(name: str, slots_per_day: int) -> tuple[int, int, str, str] | None:
    """(day since 1980, slot, kind, suffix), or None for other names and times that are no slot's."""
    m = _NAME.match(name)
    if not m:
        return None
    try:
        day = (datetime.date(*map(int, m.groups()[:3])) - _ORIGIN).days
    except ValueError:
        return None
    minutes, step = int(m[4]) * 60 + int(m[5]), 1440 // slots_per_day
    if minutes % step or minutes >= 1440:
        return None
    return day, minutes // step, m[6], m[7]


def window(lats: tuple[float, float], lons: tuple[float, float], west: float, cells_a_degree: float = CELLS_A_DEGREE, north: float = NORTH) -> tuple[int, int, int, int]:
    """(first and past-last row, first and past-last column) of a grid for an extent in degrees."""
    rows = int((north - lats[1]) * cells_a_degree), int((north - lats[0]) * cells_a_degree)
    return *rows, int((lons[0] - west) * cells_a_degree), int((lons[1] - west) * cells_a_degree)


@dataclass
class OneSlot(InputPartition):
    dfb: int
    slot: int
    path: str | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = options.get
        self.path, self.kind = options["path"], get("kind", "CSP").upper()
        if self.kind not in KINDS:
            raise ValueError(f"the kind is one of {KINDS}")
        self.holes = get("holes", "keep")
        if self.holes not in ("keep", "remove"):
            raise ValueError("holes are kept or removed")
        self.slots_per_day, self.slot_step, self.suffix = int(get("slots_per_day", "4")), int(get("slot_step", "1")), get("suffix", SUFFIX)
        self.days = [int(options["first_day"]), int(options["last_day"])]
        self.origin, self.slots = self.days[0], [0, self.slots_per_day - 1]
        self.wanted: dict[str, set[int]] = {}
        self.rows = tuple(int(x) for x in get("window", "").split(",")) if get("window") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds dfb and slot; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            span = {"dfb": self.days, "slot": self.slots}.get(name)
            if span is None or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In):
                yield f
            elif isinstance(f, In):
                self.wanted[name] = self.wanted.get(name, set(f.value)) & set(f.value)
            else:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    span[0] = max(span[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    span[1] = min(span[1], f.value - isinstance(f, LessThan))

    def partitions(self) -> list[OneSlot]:
        where, base = open_path(self.path)
        files = {}
        for info in where.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            found = parse_name(info.base_name, self.slots_per_day)
            if found and found[2:] == (self.kind, self.suffix):
                files[found[:2]] = info.path
        slots = [
            (day, slot)
            for day in range(self.days[0], self.days[1] + 1) if day in self.wanted.get("dfb", {day})
            for slot in range(0, self.slots_per_day, self.slot_step) if self.slots[0] <= slot <= self.slots[1] and slot in self.wanted.get("slot", {slot})
        ]
        kept = [OneSlot(*s, files.get(s)) for s in slots if s in files or (self.holes == "keep" and self.rows)]
        return kept or [OneSlot(0, 0, None)]

    def _raster(self, path: str | None) -> np.ndarray | None:
        if path is None:
            return None
        try:
            with open_path(self.path)[0].open_input_file(path) as f:
                raster = np.load(io.BytesIO(f.read()), allow_pickle=False).astype(np.float64)
            if raster.ndim != 2:
                return None
        except (OSError, ValueError, EOFError):
            return None
        return raster if self.rows is None else raster[self.rows[0] : self.rows[1], self.rows[2] : self.rows[3]]

    def read(self, partition: OneSlot) -> Iterator[pa.RecordBatch]:
        raster = self._raster(partition.path)
        if raster is None:
            if self.holes == "remove" or self.rows is None or (partition.dfb, partition.slot, partition.path) == (0, 0, None):
                return
            raster = np.full((self.rows[1] - self.rows[0], self.rows[3] - self.rows[2]), HOLE)
        lat, lon = (x.ravel() for x in np.indices(raster.shape, dtype=np.int32))
        flat = raster.ravel()
        gone = np.isnan(flat) | (flat == MISSING.get(self.kind, np.nan))
        labels = pa.array(np.where(gone, HOLE, flat), pa.float64()) if self.holes == "keep" else pa.array(flat, pa.float64(), mask=gone)
        t = (partition.dfb - self.origin) * self.slots_per_day + partition.slot
        same = [pa.array(np.full(len(flat), x, np.int32)) for x in (t, partition.dfb, partition.slot)]
        yield pa.RecordBatch.from_arrays([*same, pa.array(lat), pa.array(lon), labels], names=["t", "dfb", "slot", "lat_i", "lon_i", "label"])


class SlotFiles(DataSource):
    """Options: path, first_day, last_day (days since 1980, both included); kind, holes, slots_per_day, slot_step, suffix, window (see `window`)."""

    @classmethod
    def name(cls) -> str:
        return "slotfiles"

    def schema(self) -> str:
        return "t int, dfb int, slot int, lat_i int, lon_i int, label double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_slots(spark: SparkSession, path: str, first_day: int, last_day: int, **options: object) -> DataFrame:
    """Labels of the days (both included); filters on dfb and slot go on to the file names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SlotFiles)
    return spark.read.format("slotfiles").options(path=path, first_day=first_day, last_day=last_day, **options).load()


def write_slots(labels: DataFrame, path: str, kind: str, slots_per_day: int, shape: tuple[int, int], suffix: str = SUFFIX) -> DataFrame:
    """Writes a file for each (dfb, slot) of labels (lat_i, lon_i, label), each by one task; missing cells are NaN.

    Returns the lazy manifest (dfb, slot, path): the files are there when it
    has been read.  A task that runs again writes the same file again.
    """
    missing = MISSING.get(kind, np.nan)

    def run(part):
        dfb, slot = int(part["dfb"].iloc[0]), int(part["slot"].iloc[0])
        raster = np.full(shape, missing)
        raster[part["lat_i"].to_numpy(), part["lon_i"].to_numpy()] = part["label"].fillna(missing).to_numpy()
        where, base = open_path(path)
        where.create_dir(base, recursive=True)
        name = file_name(dfb, slot, kind, slots_per_day, suffix)
        raw = io.BytesIO()
        np.save(raw, raster)
        with where.open_output_stream(f"{base}/{name}") as out:
            out.write(raw.getvalue())
        return part[["dfb", "slot"]].head(1).assign(path=f"{path}/{name}")

    kept = labels.select(F.col("dfb").cast("int").alias("dfb"), F.col("slot").cast("int").alias("slot"), "lat_i", "lon_i", F.col("label").cast("double").alias("label"))
    return kept.groupBy("dfb", "slot").applyInPandas(run, "dfb int, slot int, path string")


def reduce_foreign(label: Column) -> Column:
    """0 for another algorithm's clear class (2), else 1, also where it has none."""
    return F.when(label == 2, 0).otherwise(1)
