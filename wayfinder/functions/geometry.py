"""Plane geometry as Column expressions. Points are structs (x, y); rings and lines are arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def squared(ax, ay, bx, by) -> Column:
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    return dx * dx + dy * dy


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a["x"], a["y"], b["x"], b["y"]))


def nearly_equal(a: Column, b: Column, by: float = 1e-9) -> Column:
    """Do two points agree within `by` on both axes? Two nulls agree."""
    return F.coalesce((F.abs(a["x"] - b["x"]) <= by) & (F.abs(a["y"] - b["y"]) <= by), a.isNull() & b.isNull())


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def scaled(a: Column, k) -> Column:
    return point(a["x"] * _c(k), a["y"] * _c(k))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The unit vector; null for a vector of no length."""
    n = length(a)
    return F.when(n > 0, point(a["x"] / n, a["y"] / n))


def perpendicular(a: Column) -> Column:
    return point(a["y"], -a["x"])


def square(p: Column, half: float, crossed: bool = False) -> Column:
    """The corners of the square around p, counter-clockwise; crossed gives the order in which the sides cross."""
    corners = ((-1, -1), (-1, 1), (1, -1), (1, 1)) if crossed else ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[point(p["x"] + i * half, p["y"] + j * half) for i, j in corners])


def segment_box(a: Column, b: Column, half: float) -> Column:
    """The rectangle around a segment, longer by half at both ends; null for a segment of no length."""

    def corners(along: Column) -> Column:
        side = perpendicular(along)
        tail, head = subtract(a, along), add(b, along)
        return F.array(add(tail, side), add(head, side), subtract(head, side), subtract(tail, side))

    unit = normalized(subtract(b, a))
    return F.when(unit.isNotNull(), let(scaled(unit, half), corners))


def segment_boxes(line: Column, half: float) -> Column:
    at = F.sequence(F.lit(0), F.size(line) - 2)
    boxes = F.transform(at, lambda i: segment_box(F.get(line, i), F.get(line, i + 1), half))
    return F.when(F.size(line) > 1, F.filter(boxes, lambda b: b.isNotNull())).otherwise(F.array().cast(f"array<{RING}>"))


def after(ring: Column, i: Column) -> Column:
    """The vertex behind the i-th; the first behind the last."""
    return F.get(ring, (i + 1) % F.size(ring))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for counter-clockwise rings; open and closed rings give the same."""
    parts = F.transform(ring, lambda p, i: p["x"] * after(ring, i)["y"] - after(ring, i)["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2


def open_ring(ring: Column) -> Column:
    """Without a last vertex that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def clean_ring(ring: Column) -> Column:
    """Open, and without vertices equal to the one before."""
    return let(open_ring(ring), lambda r: F.filter(r, lambda p, i: (F.size(r) == 1) | (p != F.get(r, (i + F.size(r) - 1) % F.size(r)))))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_max(xs).alias("maxx"), F.array_min(ys).alias("miny"), F.array_max(ys).alias("maxy"))


def segments_meet(ax, ay, bx, by, px, py, qx, qy) -> Column:
    """Do segments a-b and p-q have a point in common? End points count; parallel segments, also overlapping ones, and
    segments of no length never do. Signs decide, without division, so whole coordinates give exact answers."""
    ax, ay, bx, by, px, py, qx, qy = map(_c, (ax, ay, bx, by, px, py, qx, qy))
    cross = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
    t = (px - ax) * (qy - py) - (py - ay) * (qx - px)
    u = (px - ax) * (by - ay) - (py - ay) * (bx - ax)
    return ((cross > 0) & t.between(0, cross) & u.between(0, cross)) | ((cross < 0) & t.between(cross, 0) & u.between(cross, 0))


def meets_ring(a: Column, b: Column, ring: Column) -> Column:
    """Does segment a-b meet a side of the ring, the closing one included? One wholly inside doesn't."""
    hit = lambda p, i: segments_meet(a["x"], a["y"], b["x"], b["y"], p["x"], p["y"], after(ring, i)["x"], after(ring, i)["y"])
    return F.exists(F.transform(ring, hit), lambda x: x)


def ring_sides(ring: Column) -> Column:
    """The sides (ax, ay, bx, by), the closing one included."""
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), after(ring, i)["x"].alias("bx"), after(ring, i)["y"].alias("by")))


def inside_ring(p: Column, ring: Column) -> Column:
    """Even-odd test."""

    def crosses(v: Column, i: Column) -> Column:
        w = after(ring, i)
        above, next_above = v["y"] > p["y"], w["y"] > p["y"]
        at = v["x"] + (p["y"] - v["y"]) / F.nullif(w["y"] - v["y"], F.lit(0.0)) * (w["x"] - v["x"])
        return F.when((above != next_above) & (p["x"] < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def projection(px, py, ax, ay, bx, by) -> Column:
    """t in [0, 1] of the point of segment a-b nearest to p; 0 for a segment of no length."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    n = squared(ax, ay, bx, by)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(n, n * 0)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0)


def point_segment(p: Column, a: Column, b: Column) -> Column:
    t = projection(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"])
    return distance(p, add(a, scaled(subtract(b, a), t)))


def segment_distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Least distance of two segments, 0 where they meet."""
    meet = segments_meet(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"], d["x"], d["y"])
    return F.when(meet, 0.0).otherwise(F.least(point_segment(a, c, d), point_segment(b, c, d), point_segment(c, a, b), point_segment(d, a, b)))


def outward_normals(ring: Column) -> Column:
    """The unit normal of each side that points out of a clean ring."""
    sign = F.when(signed_area(ring) < 0, -1.0).otherwise(1.0)
    return let(sign, lambda s: F.transform(ring, lambda p, i: scaled(normalized(perpendicular(subtract(after(ring, i), p))), s)))


def offset_ring(ring: Column, by: float = 0.1, most: float = 2.0) -> Column:
    """The ring pushed outward by `by`: mitred corners, or two bevelled ones where a mitre is longer than `most` times that.

    Rings of fewer than three vertices, once cleaned, stay as they are."""

    def corners(r: Column) -> Column:
        def of(normals: Column) -> Column:
            def corner(p: Column, i: Column) -> Column:
                before, behind = F.get(normals, (i + F.size(r) - 1) % F.size(r)), F.get(normals, i)
                bisector = add(before, behind)
                reach = dot(bisector, before)
                mitre = scaled(bisector, 1.0 / F.nullif(reach, F.lit(0.0)))
                fits = (reach > 1e-9) & (length(mitre) <= most)
                return F.when(fits, F.array(add(p, scaled(mitre, by)))).otherwise(F.array(add(p, scaled(before, by)), add(p, scaled(behind, by))))

            return F.flatten(F.transform(r, corner))

        return F.when(F.size(r) < 3, r).otherwise(let(outward_normals(r), of))

    return let(clean_ring(ring), corners)


def cell(v, size: float) -> Column:
    return F.floor(_c(v) / size).cast("long")


#: Fixed values of the projected system: transverse Mercator on the GRS80 ellipsoid.
A, FLAT, LON0, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257222101, 11.75, 0.99998, 600000.0, -5000000.0


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Meridian radius, and the coefficients of the forward, inverse and latitude series in the third flattening."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, forward, inverse, latitude


def project(lat, lon) -> tuple[Column, Column]:
    """Projected (x, y) in metres of degrees."""
    radius, forward, _, _ = _series()
    n = FLAT / (2 - FLAT)
    c = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(forward, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + SCALE * radius * x, NORTH + SCALE * radius * y


def unproject(x, y) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of projected metres."""
    radius, _, inverse, latitude = _series()
    eta, xi = (_c(x) - EAST) / (SCALE * radius), (_c(y) - NORTH) / (SCALE * radius)
    e, s = eta, xi
    for k, b in enumerate(inverse, 1):
        e = e - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        s = s - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    chi = F.asin(F.sin(s) / F.cosh(e))
    phi = chi
    for k, d in enumerate(latitude, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return F.degrees(phi), LON0 + F.degrees(F.atan2(F.sinh(e), F.cos(s)))
