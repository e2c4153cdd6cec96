"""Geometry as column expressions: distances, bearings, cells, bands and boxes. All stay inside generated code.

A missing input gives NULL. Constants are fixed values: mean earth radius in km, km per nautical mile, 60 nm a degree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0088
KM_PER_NM = 1.852
NM_PER_DEGREE = 60.0


def col(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the haversine is held in [0, 1] against rounding."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    held = F.when(a > 1, 1.0).when(a < 0, 0.0).otherwise(a)  # a NULL stays NULL, which greatest() would hide
    return 2 * EARTH_KM * F.asin(F.sqrt(held))


def range_nm(lat1, lon1, lat2, lon2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) / KM_PER_NM


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from point 1 to point 2, clockwise from north in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_difference(a, b) -> Column:
    """a - b wrapped into [-180, 180)."""
    return F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0


def offset_point(lat, lon, bearing, distance_nm) -> tuple[Column, Column]:
    """The point at a distance along a bearing, on a flat earth of 60 nm a degree."""
    lat, lon, b, d = map(col, (lat, lon, bearing, distance_nm))
    return lat + d / NM_PER_DEGREE * F.cos(F.radians(b)), lon + d / NM_PER_DEGREE * F.sin(F.radians(b)) / F.cos(F.radians(lat))


def in_annulus(range_, low: float, high: float) -> Column:
    return col(range_).between(low, high)


def bands(value, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first band whose upper border lies above the value; NULL gets the rest."""
    out, v = None, col(value)
    for border, name in cuts:
        out = F.when(v < border, name) if out is None else out.when(v < border, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def right_open_bins(value, borders: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for borders[i] <= value < borders[i + 1]; NULL outside and for NULL."""
    out = None
    for low, high, name in zip(borders, borders[1:], names, strict=False):
        test = (col(value) >= low) & (col(value) < high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def cell(lat, lon, degrees: float) -> Column:
    """Key of the grid cell that holds a point: 'row_column'."""
    return F.concat_ws("_", F.floor(col(lat) / degrees).cast("string"), F.floor(col(lon) / degrees).cast("string"))


def cell_row(value, degrees: float) -> Column:
    return F.floor(col(value) / degrees).cast("long")


def closest_approach(e0, n0, e1, n1, dt) -> tuple[Column, Column]:
    """Distance and time of closest approach to the origin at constant velocity, from the segment's start.

    A segment without duration has neither; one without motion has its distance and no time.
    """
    e0, n0, e1, n1, dt = map(col, (e0, n0, e1, n1, dt))
    ve, vn = (e1 - e0) / dt, (n1 - n0) / dt
    speed2 = ve * ve + vn * vn
    t = -(e0 * ve + n0 * vn) / speed2
    moving = F.when((dt > 0) & (speed2 > 0), t)
    distance = F.when(dt > 0, F.when(speed2 > 0, F.hypot(e0 + ve * t, n0 + vn * t)).otherwise(F.hypot(e0, n0)))
    return distance, moving


def local_plane(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """East and north of a reference point, in nm."""
    lat, lon, lat0, lon0 = map(col, (lat, lon, lat0, lon0))
    return (lon - lon0) * NM_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * NM_PER_DEGREE


def iou(a: Sequence, b: Sequence) -> Column:
    """Intersection over union of two boxes (x, y, width, height); 0 without area."""
    ax, ay, aw, ah, bx, by, bw, bh = map(col, (*a, *b))
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def clamp_box(x, y, w, h, width, height, least: float = 1.0) -> Column:
    """struct(x, y, w, h) inside the image, to 2 places; NULL if a side falls under ``least``."""
    x, y, w, h, width, height = map(col, (x, y, w, h, width, height))
    x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    box = F.struct(F.round(x0, 2).alias("x"), F.round(y0, 2).alias("y"), F.round(x1 - x0, 2).alias("w"), F.round(y1 - y0, 2).alias("h"))
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), box)


def letterbox(width, height, size: int) -> Column:
    """struct(scale, new_w, new_h, pad_x, pad_y) of an image fitted into a square; sides round half to even."""
    width, height = col(width), col(height)
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    nw, nh = F.bround(width * scale, 0).cast("int"), F.bround(height * scale, 0).cast("int")
    pad = lambda n: F.floor((F.lit(size) - n) / 2).cast("int")
    return F.struct(scale.alias("scale"), nw.alias("new_w"), nh.alias("new_h"), pad(nw).alias("pad_x"), pad(nh).alias("pad_y"))


def letterbox_box(x, y, w, h, fit: str) -> Column:
    f = F.col(fit)
    x, y, w, h = map(col, (x, y, w, h))
    return F.struct((x * f["scale"] + f["pad_x"]).alias("x"), (y * f["scale"] + f["pad_y"]).alias("y"), (w * f["scale"]).alias("w"), (h * f["scale"]).alias("h"))


def yolo_box(x, y, w, h, width, height) -> Column:
    """struct(cx, cy, w, h) as shares of the image."""
    x, y, w, h, width, height = map(col, (x, y, w, h, width, height))
    return F.struct(((x + w / 2) / width).alias("cx"), ((y + h / 2) / height).alias("cy"), (w / width).alias("w"), (h / height).alias("h"))


def hamming(a, b) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def overlay_bands(height, top: float = 0.06, bottom: float = 0.06) -> Column:
    """struct(y0, y1): the rows of an image between its caption bands, whose heights are shares of its own."""
    h = col(height)
    return F.struct(F.bround(h * top, 0).cast("int").alias("y0"), (h - F.bround(h * bottom, 0)).cast("int").alias("y1"))
