"""Navigation: geodetic coordinates, scan angles, line and column, tiles; all closed-form columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: GRS80 axes, orbit radius (metres), GDAL-style geostationary grid
REQ, RPOL, ORBIT = 6378137.0, 6356752.31414, 42164160.0
E2 = 1 - (RPOL / REQ) ** 2


def ll_to_angles(lat: Column, lon: Column, lon0: float) -> tuple[Column, Column]:
    """(line angle, column angle) in radians seen from the satellite over lon0 (degrees)."""
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    phi_c = F.atan((RPOL / REQ) ** 2 * F.tan(phi))
    rc = RPOL / F.sqrt(1 - E2 * F.pow(F.cos(phi_c), 2))
    sx = ORBIT - rc * F.cos(phi_c) * F.cos(lam)
    sy = -rc * F.cos(phi_c) * F.sin(lam)
    sz = rc * F.sin(phi_c)
    return F.atan(sz / sx), F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))


def angles_to_ll(y: Column, x: Column, lon0: float) -> tuple[Column, Column]:
    """(lat, lon) in degrees of a line angle y and a column angle x; null off the disk."""
    a = F.pow(F.sin(x), 2) + F.pow(F.cos(x), 2) * (F.pow(F.cos(y), 2) + (REQ / RPOL) ** 2 * F.pow(F.sin(y), 2))
    b = -2 * ORBIT * F.cos(x) * F.cos(y)
    c = ORBIT**2 - REQ**2
    d = b * b - 4 * a * c
    rs = F.when(d >= 0, (-b - F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * a))
    sx, sy, sz = rs * F.cos(x) * F.cos(y), -rs * F.sin(x), rs * F.cos(x) * F.sin(y)
    lat = F.degrees(F.atan((REQ / RPOL) ** 2 * sz / F.sqrt(F.pow(ORBIT - sx, 2) + sy * sy)))
    return lat, lon0 - F.degrees(F.atan(sy / (ORBIT - sx)))


def angle_to_index(angle: Column, resolution: float, offset: float) -> Column:
    return F.floor((angle - offset) / resolution).cast("int")


def index_to_centre(index: Column, resolution: float, offset: float) -> Column:
    return offset + index * resolution + resolution / 2


def reproject(raster: DataFrame, targets: DataFrame, lon0: float, resolution: float, offset: float) -> DataFrame:
    """targets (lat, lon, ...) with the raster's nearest value: both sides meet on (line, column), by key."""
    y, x = ll_to_angles(F.col("lat"), F.col("lon"), lon0)
    keyed = targets.withColumn("l", angle_to_index(y, resolution, offset)).withColumn("c", angle_to_index(x, resolution, offset))
    return keyed.join(raster, ["l", "c"], "left")


def tile_of(lat: Column, lon: Column) -> tuple[Column, Column]:
    """5-degree tile (row, column); exact multiples belong to the next tile south and east."""
    south = F.when(lat % 5 == 0, lat - 1).otherwise(lat)
    east = F.when(lon % 5 == 0, lon + 1).otherwise(lon)
    return (F.ceil((90 - south) / 5) - 1).cast("int"), (F.ceil((180 + east) / 5) - 1).cast("int")


def tile_corner(row: Column, column: Column) -> tuple[Column, Column]:
    return 90.0 - 5 * (1 + row), -180.0 + 5 * column


def encode_labels(labels: Column, base: int = 6) -> Column:
    """A list of digits as one number, the first the lowest."""
    return F.aggregate(F.reverse(labels), F.lit(0).cast("long"), lambda acc, d: acc * base + d)


def decode_labels(code: Column, size: int, base: int = 6) -> Column:
    return F.array(*(F.floor(code / base**k).cast("long") % base for k in range(size)))


#: fixed values: axes and height (metres) of the plain geostationary projection
AXIS_A, AXIS_B, HEIGHT = 6378169.0, 6356583.8, 35785831.0


def ll_to_plane(lat: Column, lon: Column, lon0: float) -> tuple[Column, Column]:
    """(Y, X) in metres of the geostationary projection; null where the satellite does not see the point."""
    p2 = (AXIS_B / AXIS_A) ** 2
    lam = F.radians(lon - lon0)
    phi = F.atan(p2 * F.tan(F.radians(lat)))
    r = (AXIS_B / AXIS_A) / F.sqrt(F.pow((AXIS_B / AXIS_A) * F.cos(phi), 2) + F.pow(F.sin(phi), 2))
    vx, vy, vz = r * F.cos(lam) * F.cos(phi), r * F.sin(lam) * F.cos(phi), r * F.sin(phi)
    far = 1 + HEIGHT / AXIS_A
    seen = (far - vx) * vx - vy * vy - vz * vz / p2 >= 0
    y = F.when(seen, HEIGHT * F.atan(vz / F.sqrt(F.pow(far - vx, 2) + vy * vy)))
    return y, F.when(seen, HEIGHT * F.atan(vy / (far - vx)))


def plane_to_ll(y: Column, x: Column, lon0: float) -> tuple[Column, Column]:
    """(lat, lon) in degrees; null off the disk."""
    far, q = 1 + HEIGHT / AXIS_A, AXIS_A / AXIS_B
    ty = F.tan(x / HEIGHT)
    tz = F.tan(y / HEIGHT) * F.sqrt(1 + ty * ty)
    a = 1 + ty * ty + F.pow(tz * q, 2)
    b, c = -2.0 * far, far * far - 1
    d = b * b - 4 * a * c
    k = F.when(d >= 0, (-b - F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * a))
    vx, vy, vz = far - k, k * ty, k * tz
    lam = F.atan2(vy, vx)
    phi = F.atan(vz * F.cos(lam) / vx)
    return F.degrees(F.atan(q * q * F.tan(phi))), F.degrees(lam) + lon0


def plane_to_index(y: Column, x: Column, top: float, left: float, y_step: float, x_step: float, exact: bool = False) -> tuple[Column, Column]:
    """(line, column); with `exact` the inverse of index_to_plane, else one half a pixel further."""
    half = 0.0 if exact else 0.5
    return F.floor((y - top) / y_step + half).cast("int"), F.floor((x - left) / x_step + half).cast("int")


def index_to_plane(line: Column, column: Column, top: float, left: float, y_step: float, x_step: float) -> tuple[Column, Column]:
    return index_to_centre(line, y_step, top), index_to_centre(column, x_step, left)


def renavigate(raster: DataFrame, lon_from: float, lon_to: float, resolution: float, offset: float) -> DataFrame:
    """A raster (l, c, ...) seen from another longitude: each target pixel's value is the source's at the same place.

    Target pixels are those of the raster's own grid; both sides meet on (line, column), by key.
    """
    lat, lon = angles_to_ll(index_to_centre(F.col("l"), resolution, offset), index_to_centre(F.col("c"), resolution, offset), lon_to)
    y, x = ll_to_angles(lat, lon, lon_from)
    targets = raster.select(F.col("l").alias("to_l"), F.col("c").alias("to_c"), angle_to_index(y, resolution, offset).alias("l"), angle_to_index(x, resolution, offset).alias("c"))
    return targets.join(raster, ["l", "c"], "left").drop("l", "c").withColumnsRenamed({"to_l": "l", "to_c": "c"})
