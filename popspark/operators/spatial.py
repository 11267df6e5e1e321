"""Points in zones: polygons as rings of coordinates, an equi-join on grid cells, ray casting in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of (x, y): an odd number of its edges lie to the right of the point.

    An edge counts where it runs from one side of the point's height to the
    other, its lower end included; so a point on a left or lower edge is inside,
    on a right or upper one outside, and polygons that share an edge share no
    point. The ring need not repeat its first point.
    """
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        at = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > py) != (b["y"] > py), F.when(px < at, 1).otherwise(0)).otherwise(0)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, i: t + crossing(i)) % 2 == 1).otherwise(F.lit(False))


def polygon_cells(zones: DataFrame, ring: str, size: float, most: int = 1_000_000) -> DataFrame:
    """``zones`` once for each grid cell (``__cx``, ``__cy``) that its bounding box meets; more than ``most`` for one raise."""
    side = lambda c: F.transform(ring, lambda p: p[c])
    box = zones.withColumns({"__minx": F.array_min(side("x")), "__maxx": F.array_max(side("x")), "__miny": F.array_min(side("y")), "__maxy": F.array_max(side("y"))})
    xs = [cell(F.col(f"__{f}x"), size) for f in ("min", "max")]
    ys = [cell(F.col(f"__{f}y"), size) for f in ("min", "max")]
    n = (xs[1] - xs[0] + 1) * (ys[1] - ys[0] + 1)
    box = box.where(F.size(ring) >= 3).withColumn("__n", F.when(n > most, F.raise_error(F.lit("a polygon covers too many cells: take larger ones"))).otherwise(n))
    box = box.withColumn("__cx", F.explode(F.sequence(*xs))).withColumn("__cy", F.explode(F.sequence(*ys)))
    return box.drop("__minx", "__maxx", "__miny", "__maxy", "__n")


def points_in_zones(points: DataFrame, zones: DataFrame, x: str = "x", y: str = "y", ring: str = "ring", size: float = 1.0) -> DataFrame:
    """Each point with every zone whose ring holds it; points in none give no row.

    Points meet the zones of their grid cell only. A cell with many points is
    split by the engine's skew handling, as the zones' side is small there. A
    null coordinate is in no zone, and a ring of fewer than three points holds none.
    """
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__cx": cell(F.col(x), size), "__cy": cell(F.col(y), size)})
    z = polygon_cells(zones, ring, size)
    return p.join(z, ["__cx", "__cy"]).where(inside(F.col(x), F.col(y), F.col(ring))).drop("__cx", "__cy")


def crosswalk(points: DataFrame, zones: DataFrame, point_id: str, zone: str, **how) -> DataFrame:
    """(point_id, zone): the first zone by name that holds each point, null where none does."""
    got = points_in_zones(points, zones, **how).groupBy(point_id).agg(F.min(zone).alias(zone))
    return points.select(point_id).distinct().join(got, point_id, "left")


def zone_series(zones: DataFrame, bars: DataFrame, heat: DataFrame, zone: str = "zone_id", bar: str = "value", heat_value: str = "value") -> DataFrame:
    """``zones`` with a ``bar`` and a ``heat`` value by zone, 0 where a zone has none; several rows of a zone add up."""
    one = lambda df, c, name: df.groupBy(zone).agg(F.sum(c).alias(name))
    out = zones.join(one(bars, bar, "bar"), zone, "left").join(one(heat, heat_value, "heat"), zone, "left")
    return out.na.fill(0, ["bar", "heat"])
