"""From pixels to places: affine grids, UTM, equal-area sizes, geodesic lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from prismal.operators import regions
from prismal.session import ship

#: The WGS84 ellipsoid and the UTM scale.
A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
E2 = FLAT * (2 - FLAT)


def world(transform: dict[str, float], row: Column, col: Column, *, centre: bool = True) -> tuple[Column, Column]:
    """(x, y) in map units of a pixel's centre, or of its upper left corner, under an affine grid a..f."""
    h = 0.5 if centre else 0.0
    c, r = col + h, row + h
    return transform["a"] * c + transform["b"] * r + transform["c"], transform["d"] * c + transform["e"] * r + transform["f"]


def utm_to_wgs84(x: Column, y: Column, zone: int, *, north: bool = True, of=F) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees by the Krueger series, to well under a millimetre within a zone. With of=np, of arrays."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (y - (0.0 if north else 1e7)) / (K0 * radius)
    eta = (x - 500000.0) / (K0 * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * of.sin(2 * j * xi) * of.cosh(2 * j * eta)
        eta1 = eta1 - b * of.cos(2 * j * xi) * of.sinh(2 * j * eta)
    chi = of.asin(of.sin(xi1) / of.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * of.sin(2 * j * chi)
    lon = (zone * 6 - 183.0) + of.degrees(of.atan2(of.sinh(eta1), of.cos(xi1)))
    return lon, of.degrees(lat)


def equal_area(lon: Column, lat: Column, *, of=F) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates with true scale at 30 degrees. With of=np, of arrays."""
    s = of.sin(of.radians(lat))
    e = np.sqrt(E2)
    k0 = np.cos(np.radians(30)) / np.sqrt(1 - E2 * np.sin(np.radians(30)) ** 2)
    q = (1 - E2) * (s / (1 - E2 * s * s) - of.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return A * k0 * of.radians(lon), A * q / (2 * k0)


def ring_area(xs: Column, ys: Column) -> Column:
    """Area of a closed ring given as two arrays whose last element repeats the first."""
    n = F.size(xs)
    cross = F.zip_with(F.arrays_zip(F.slice(xs, 1, n - 1).alias("x"), F.slice(ys, 1, n - 1).alias("y")), F.arrays_zip(F.slice(xs, 2, n - 1).alias("x"), F.slice(ys, 2, n - 1).alias("y")), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v)) / 2


def geodesic(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Length in metres of the geodesic between points in degrees, by Vincenty's iteration (not for antipodes)."""
    b = A * (1 - FLAT)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(lat1))), np.arctan((1 - FLAT) * np.tan(np.radians(lat2)))
    gap = lam = np.radians(lon2 - lon1)
    for _ in range(30):
        s = np.sqrt((np.cos(u2) * np.sin(lam)) ** 2 + (np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)) ** 2)
        c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(s, c)
        alpha = np.divide(np.cos(u1) * np.cos(u2) * np.sin(lam), s, out=np.zeros_like(s), where=s > 0)
        cos2 = 1 - alpha**2
        mid = np.where(cos2 > 1e-15, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 > 1e-15, cos2, 1), 0)
        k = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
        lam = gap + (1 - k) * FLAT * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
    u = cos2 * (A**2 - b**2) / b**2
    big, small = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    turn = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return np.where(s > 0, b * big * (sigma - turn), 0.0)


def perimeter(rings: DataFrame, lons: str, lats: str) -> DataFrame:
    """rings with perimeter_m, the geodesic length of each closed ring of degrees."""

    @F.pandas_udf("double")
    def length(lon: pd.Series, lat: pd.Series) -> pd.Series:
        n = np.array([max(0, len(x) - 1) for x in lon], np.int64)
        ends = lambda v, part: np.concatenate([np.zeros(0), *(np.asarray(x[part], float) for x in v)])
        first, last = slice(None, -1), slice(1, None)
        each = geodesic(ends(lon, first), ends(lat, first), ends(lon, last), ends(lat, last))  # the sides of all rings at once
        return pd.Series(np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)))

    return rings.withColumn("perimeter_m", length(lons, lats))


def boundary_edges(labelled: DataFrame) -> DataFrame:
    """(scene_id, label, x0, y0, x1, y1): unit edges between a region and what isn't it, the region to their right.

    Pixels meet their neighbours inside of a tile, to which the pixels next to it come too: only pixels are dealt out,
    never their sides.
    """
    ship(labelled.sparkSession)
    kind, t = dict(labelled.dtypes)["label"], regions.TILE
    sides = ((-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1), (1, 0, 1, 1, 0, 1), (0, -1, 0, 1, 0, 0))

    def open_sides(batches):
        for table, group in regions.whole_groups(batches, ["scene_id", "_tr", "_tc"]):
            r, c, tr, tc = regions._ints(table, "r", "c", "_tr", "_tc")
            label = table["label"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            _, piece = np.unique(group * (int(label.max()) + 1) + label, return_inverse=True)  # of a region in a tile
            width = t + 2
            at = (piece * width + r - tr * t + 1) * width + c - tc * t + 1
            known = np.unique(at)
            own = np.flatnonzero((r // t == tr) & (c // t == tc))
            rows, ends = [], []
            for dr, dc, a, b, d, e in sides:
                near = at[own] + dr * width + dc
                edge = own[known[np.minimum(np.searchsorted(known, near), len(known) - 1)] != near]
                rows.append(edge)
                ends.append(np.stack([c[edge] + a, r[edge] + b, c[edge] + d, r[edge] + e]))
            rows, ends = np.concatenate(rows), np.concatenate(ends, 1)
            of = table.select(["scene_id", "label"]).take(rows)
            yield pa.RecordBatch.from_pydict({"scene_id": of["scene_id"].combine_chunks(), "label": of["label"].combine_chunks(), **dict(zip(("x0", "y0", "x1", "y1"), ends))})

    tile = lambda x, d: F.floor((F.col(x) + d) / t).cast("long")
    places = F.array_distinct(F.array(*(F.struct(tile("r", dr).alias("r"), tile("c", dc).alias("c")) for dr, dc in ((0, 0), *(x[:2] for x in sides)))))
    inner = (F.pmod("r", F.lit(t)).between(1, t - 2)) & (F.pmod("c", F.lit(t)).between(1, t - 2))
    home = F.array(F.struct(tile("r", 0).alias("r"), tile("c", 0).alias("c")))
    dealt = labelled.select("scene_id", "label", "r", "c", F.explode(F.when(inner, home).otherwise(places)).alias("_t")).select("scene_id", "label", "r", "c", F.col("_t.r").alias("_tr"), F.col("_t.c").alias("_tc"))
    dealt = dealt.repartition("scene_id", "_tr", "_tc").sortWithinPartitions("scene_id", "_tr", "_tc")
    return dealt.mapInArrow(open_sides, f"scene_id string, label {kind}, x0 long, y0 long, x1 long, y1 long")


def centroid(rings: Column) -> tuple[Column, Column]:
    """(x, y) of the centre of area of a polygon: an array of closed rings of [x, y], the outer one first, then holes."""

    def sums(ring: Column) -> Column:
        n = F.size(ring)
        pairs = F.arrays_zip(F.slice(ring, 1, n - 1).alias("p"), F.slice(ring, 2, n - 1).alias("q"))
        origin = F.get(F.get(rings, F.lit(0)), F.lit(0))
        at = lambda p, k: F.get(p, F.lit(k)) - F.get(origin, F.lit(k))
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def step(t, e):
            cross = at(e["p"], 0) * at(e["q"], 1) - at(e["q"], 0) * at(e["p"], 1)
            return F.struct((t["a"] + cross).alias("a"), (t["x"] + (at(e["p"], 0) + at(e["q"], 0)) * cross).alias("x"), (t["y"] + (at(e["p"], 1) + at(e["q"], 1)) * cross).alias("y"))

        return F.aggregate(pairs, zero, step)

    # The outer ring counts, holes count against it, whichever way they turn.
    signed = F.transform(rings, lambda ring, i: F.get(F.transform(F.array(sums(ring)), lambda t: F.struct((t["a"] * _turn(t["a"], i)).alias("a"), (t["x"] * _turn(t["a"], i)).alias("x"), (t["y"] * _turn(t["a"], i)).alias("y"))), F.lit(0)))
    total = lambda k: F.aggregate(signed, F.lit(0.0), lambda t, e: t + e[k])
    origin = F.get(F.get(rings, F.lit(0)), F.lit(0))
    return F.get(origin, F.lit(0)) + total("x") / (3 * total("a")), F.get(origin, F.lit(1)) + total("y") / (3 * total("a"))


def _turn(area: Column, i: Column) -> Column:
    return F.when((area > 0) == (i == 0), 1.0).otherwise(-1.0)


def polygon_area(rings: Column) -> Column:
    """Area of a polygon: its outer ring less its holes."""
    size = lambda ring: ring_area(F.transform(ring, lambda p: F.get(p, F.lit(0))), F.transform(ring, lambda p: F.get(p, F.lit(1))))
    return F.aggregate(F.transform(rings, lambda ring, i: F.when(i == 0, size(ring)).otherwise(-size(ring))), F.lit(0.0), lambda t, v: t + v)


def measured(outlines: DataFrame) -> DataFrame:
    """outlines(rings) with n_rings, n_corners, and the area and centre (x, y) of the polygon, in the units of its corners. Those of a batch are worked out together."""
    ship(outlines.sparkSession)

    def sizes(batches):
        for batch in batches:
            x, y, n_rings, n_points = _corners(batch)
            area, mid_x, mid_y = _plane(x, y, n_rings, n_points)
            missing = n_rings == 0
            corners = np.bincount(np.repeat(np.arange(len(n_rings)), n_rings), n_points - 1, len(n_rings)).astype(np.int64)
            out = dict(zip(batch.schema.names, batch.columns)) | {"n_rings": n_rings.astype(np.int64), "n_corners": corners}
            yield pa.RecordBatch.from_pydict(out | {k: pa.array(v, pa.float64(), mask=missing) for k, v in (("area", area), ("x", mid_x), ("y", mid_y))})

    kinds = StructType([*outlines.schema.fields, *(StructField(k, LongType()) for k in ("n_rings", "n_corners")), *(StructField(k, DoubleType()) for k in ("area", "x", "y"))])
    return outlines.mapInArrow(sizes, kinds)


def _corners(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x and y of all corners of a batch's rings, rings by polygon, corners by ring."""
    rings = batch.column(batch.schema.get_field_index("rings"))
    n_rings = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    each = rings.flatten()
    n_points = pc.list_value_length(each).to_numpy(zero_copy_only=False)
    x, y = each.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).T
    return x, y, n_rings, n_points


def placed(outlines: DataFrame, transform: dict[str, float], zone: int | None, *, north: bool = True) -> DataFrame:
    """outlines(rings in pixels) with the polygon in degrees, its size in square metres, its geodesic perimeter and its centre.

    With a zone the grid is in UTM metres, without one in degrees. The corners of a batch are worked out together.
    """
    ship(outlines.sparkSession)

    def measured(batches):
        for batch in batches:
            col, row, n_rings, n_points = _corners(batch)
            x, y = world(transform, row, col, centre=False)
            lon, lat = (x, y) if zone is None else utm_to_wgs84(x, y, zone, north=north, of=np)
            bound = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            points = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(lon) + 1, 2), pa.int32()), np.stack([lon, lat], 1).ravel())
            polygon = pa.ListArray.from_arrays(bound(n_rings), pa.ListArray.from_arrays(bound(n_points), points))
            out = dict(zip(batch.schema.names, batch.columns)) | {"polygon": polygon}
            missing = n_rings == 0
            for name, v in _sizes(lon, lat, n_rings, n_points).items():
                out[name] = pa.array(v, pa.float64(), mask=missing)
            yield pa.RecordBatch.from_pydict(out)

    kinds = StructType([*outlines.schema.fields, StructField("polygon", ArrayType(ArrayType(ArrayType(DoubleType())))), *(StructField(x, DoubleType()) for x in ("area", "lon", "lat", "perimeter"))])
    return outlines.mapInArrow(measured, kinds)


def _plane(x: np.ndarray, y: np.ndarray, n_rings: np.ndarray, n_points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By polygon its area and its centre of area, of closed rings, the outer ones first, then holes."""
    home = np.repeat(np.arange(len(n_rings)), n_rings)  # of each ring
    outer = np.diff(home, prepend=-1) > 0
    ring = np.repeat(np.arange(len(n_points)), n_points)  # of each point
    side = np.flatnonzero(ring[1:] == ring[:-1])  # points with a next one in their ring
    in_ring = lambda v: np.bincount(ring[side], v, len(n_points))
    in_polygon = lambda v: np.bincount(home, v, len(n_rings))
    first = np.zeros(len(n_rings), np.int64)
    first[home[outer]] = (np.cumsum(n_points) - n_points)[outer]
    u, v = x - x[first[home[ring]]], y - y[first[home[ring]]]
    cross = u[side] * v[side + 1] - u[side + 1] * v[side]
    turned = in_ring(cross)
    # The outer ring counts, holes count against it, whichever way they turn.
    sign = np.where((turned > 0) == outer, 1.0, -1.0)
    weight = 3 * in_polygon(sign * turned)
    origin = lambda w: w[first] if len(w) else np.zeros(len(n_rings))
    with np.errstate(invalid="ignore", divide="ignore"):
        mid = [origin(w) + in_polygon(sign * in_ring((d[side] + d[side + 1]) * cross)) / weight for w, d in ((x, u), (y, v))]
    return in_polygon(np.where(outer, 1, -1) * np.abs(turned)) / 2, *mid


def _sizes(lon: np.ndarray, lat: np.ndarray, n_rings: np.ndarray, n_points: np.ndarray) -> dict[str, np.ndarray]:
    """By polygon its area, its centre of area and the perimeter of its outer ring, of closed rings, the outer ones first, then holes."""
    home = np.repeat(np.arange(len(n_rings)), n_rings)  # of each ring
    outer = np.diff(home, prepend=-1) > 0
    ring = np.repeat(np.arange(len(n_points)), n_points)  # of each point
    side = np.flatnonzero(ring[1:] == ring[:-1])  # points with a next one in their ring
    around = side[outer[ring[side]]]
    length = np.bincount(home[ring[around]], geodesic(lon[around], lat[around], lon[around + 1], lat[around + 1]), len(n_rings))
    area, _, _ = _plane(*equal_area(lon, lat, of=np), n_rings, n_points)
    _, mid_lon, mid_lat = _plane(lon, lat, n_rings, n_points)
    return {"area": area, "lon": mid_lon, "lat": mid_lat, "perimeter": length}
