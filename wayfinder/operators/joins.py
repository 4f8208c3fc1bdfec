"""Spatial joins over grid cells: equi-joins on cell keys that Spark shuffles, splits or broadcasts as it sees fit.

Tables are points(id, x, y), segments(id, ax, ay, bx, by) and polygons' sides(poly_id, ax, ay, bx, by). Ties go to the
lesser id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell, ring_sides, segments_meet, squared
from ..session import checkpoint

#: Queries that may go to all tasks with their nine cells, of some 50 bytes each.
FEW = 20_000


def _around(points: DataFrame, size: float, ring: int = 1) -> DataFrame:
    """points once for each cell of the (2 ring + 1)^2 cells around theirs."""
    steps = lambda c: F.explode(F.sequence(cell(c, size) - ring, cell(c, size) + ring))
    return points.withColumn("cx", steps("x")).withColumn("cy", steps("y"))


def _own(points: DataFrame, size: float, name: str) -> DataFrame:
    return points.select(cell("x", size).alias("cx"), cell("y", size).alias("cy"), F.col("id").alias(name), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, reference: bool = False) -> DataFrame:
    """(id, other, d2) of all pairs within the radius, ends included; a point isn't its own partner.

    reference: pairs that share x or y don't count."""
    r = _own(right, radius, "other")
    d2 = squared("x", "y", "other_x", "other_y")
    met = _around(left.select("id", "x", "y"), radius).join(r, ["cx", "cy"]).where((d2 <= radius * radius) & (F.col("id") != F.col("other")))
    if reference:
        met = met.where("x <> other_x AND y <> other_y")
    return met.select("id", "other", d2.alias("d2"))


def _bounds(points: DataFrame) -> Row:
    return points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()


def _cell_size(points: DataFrame, b: Row, k: int) -> tuple[float, bool]:
    """A size of cells in which a place shares its cell with at most some k others, and whether few points share a place.

    It starts from the bounds' area and shrinks while the mean number of places in a place's cell, sum(n^2) / sum(n), is
    above that: so one far point, or points in clusters, don't make cells that hold everything."""
    places = checkpoint(points.groupBy("x", "y").agg(F.count("*").cast("double").alias("m")))
    w, h = float(b.x1 - b.x0), float(b.y1 - b.y0)
    size = max(math.sqrt(max(w, 1e-9) * max(h, 1e-9) * 3 * k / (math.pi * b.n)), 1e-6)
    mean = lambda c: F.sum(F.col(c) * F.col(c)) / F.sum(c)
    while size > 1e-6:
        mates = places.groupBy(cell("x", size), cell("y", size)).agg(F.count("*").cast("double").alias("n")).agg(mean("n")).first()[0]
        if mates <= 4 * k + 4:
            break
        size = max(size * max(0.01, math.sqrt(k / mates)), 1e-6)
    return size, places.agg(mean("m")).first()[0] <= k + 1


def _first_of_place(points: DataFrame, n: int) -> DataFrame:
    """Of points on the same place the n of least id: no others can be among the n nearest of any."""
    return points.withColumn("__nth", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("__nth") <= n).drop("__nth")


def knn_join(queries: DataFrame, points: DataFrame, k: int, with_self: bool = False) -> DataFrame:
    """(id, other, d2, rank): the k nearest points of each query, by (d2, other).

    Queries look into the ring of cells around theirs; those without k hits within a cell's size, which the ring covers, look
    again with larger cells, until a ring covers all points. Cells fit the density at most points, so most queries end in the
    first round; in later ones few queries, that are then sent to all tasks, meet the points around them; the fewer they are,
    the faster cells grow."""
    b = _bounds(points)
    if not b.n:
        return queries.select("id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("d2"), F.lit(None).cast("int").alias("rank")).limit(0)
    size, even = _cell_size(points, b, k)
    looked = points if even else checkpoint(_first_of_place(points.select("id", "x", "y"), k + 1))
    # the last ring reaches from any query over all points
    q = b if queries is points else _bounds(queries)
    far = float(max(q.x1 - b.x0, b.x1 - q.x0, q.y1 - b.y0, b.y1 - q.y0)) if q.n else 0.0
    open_, done, grow, few = queries.select("id", "x", "y"), None, 2, False
    by = Window.partitionBy("id").orderBy("d2", "other")
    while True:
        last = size > far
        around = _around(open_, size)
        met = _own(looked, size, "other").join(F.broadcast(around) if few else around, ["cx", "cy"]).withColumn("d2", squared("x", "y", "other_x", "other_y"))
        if not with_self:
            met = met.where(F.col("id") != F.col("other"))
        if not last:  # what is further may be missing from the ring
            met = met.where(F.col("d2") <= size * size)
        found = met.select("id", "other", "d2").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        if last:
            return found if done is None else done.union(found)
        found = checkpoint(found.withColumn("closed", F.count("*").over(Window.partitionBy("id")) == k))
        good = found.where("closed").drop("closed")
        done = good if done is None else done.union(good)
        open_ = checkpoint(open_.join(good.select("id").distinct(), "id", "left_anti"))
        left = open_.count()
        if not left:
            return done
        size, grow, few = size * grow, 4 if left > 1000 else 16 if left > 20 else 1024, left <= FEW


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(id, other, d2): the nearest point of each query, itself too where it is one."""
    return knn_join(queries, points, 1, with_self=True).drop("rank")


def box_match(queries: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """(id, other): the first point with both coordinates nearer than the tolerance; none if there is none."""
    met = _around(queries.select("id", "x", "y"), tolerance).join(_own(points, tolerance, "other"), ["cx", "cy"])
    near = (F.abs(F.col("x") - F.col("other_x")) < tolerance) & (F.abs(F.col("y") - F.col("other_y")) < tolerance)
    return met.where(near).groupBy("id").agg(F.min("other").alias("other"))


def rounded_match(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(id, other, exact): the point that agrees to the hundredth, else the nearest."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    same = points.groupBy(cents("x").alias("qx"), cents("y").alias("qy")).agg(F.min("id").alias("same"))
    q = queries.select("id", "x", "y", cents("x").alias("qx"), cents("y").alias("qy")).join(same, ["qx", "qy"], "left")
    near = nearest(q.where("same IS NULL"), points).select("id", F.col("other").alias("near"))
    return q.join(near, "id", "left").select("id", F.coalesce("same", "near").alias("other"), F.col("same").isNotNull().alias("exact"))


def with_cells(df: DataFrame, minx: Column, maxx: Column, miny: Column, maxy: Column, size: float) -> DataFrame:
    """df once for each cell that the box touches."""
    span = lambda a, b: F.explode(F.sequence(cell(a, size), cell(b, size)))
    return df.withColumn("cx", span(minx, maxx)).withColumn("cy", span(miny, maxy))


def segment_cells(segments: DataFrame, size: float) -> DataFrame:
    """segments once for each cell that they cross, from those of their box by a test of the cell's sides."""
    c = with_cells(segments, F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by"), size)
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    # the corners' sides of the line: all on one side, and the cell isn't crossed
    side = lambda x, y: (F.col("bx") - F.col("ax")) * (y - F.col("ay")) - (F.col("by") - F.col("ay")) * (x - F.col("ax"))
    corners = [side(x, y) for x in (x0, x0 + size) for y in (y0, y0 + size)]
    return c.where((F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))


def _hits(segments: DataFrame, sides: DataFrame, size: float) -> DataFrame:
    """(id, poly_id) of segments and the polygons that they meet."""
    s = segment_cells(segments.select("id", "ax", "ay", "bx", "by"), size)
    o = segment_cells(sides.select("poly_id", "ax", "ay", "bx", "by"), size).select("poly_id", "cx", "cy", F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"))
    box = (F.least("ax", "bx") <= F.greatest("px", "qx")) & (F.least("px", "qx") <= F.greatest("ax", "bx")) & (F.least("ay", "by") <= F.greatest("py", "qy")) & (F.least("py", "qy") <= F.greatest("ay", "by"))
    return s.join(o, ["cx", "cy"]).where(box & segments_meet("ax", "ay", "bx", "by", "px", "py", "qx", "qy")).select("id", "poly_id").distinct()


def ring_hits(segments: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """(id, poly_id) of segments and the rings(poly_id, ring) of which they meet a side, the closing one included."""
    return _hits(segments, rings.select("poly_id", F.explode(ring_sides(F.col("ring"))).alias("s")).select("poly_id", "s.*"), size)


def blocked(segments: DataFrame, sides: DataFrame, size: float) -> DataFrame:
    """The segments that meet a side of an obstacle."""
    return segments.join(_hits(segments, sides, size), "id", "left_semi")


def visible(segments: DataFrame, sides: DataFrame, size: float) -> DataFrame:
    """The segments that meet none."""
    return segments.join(_hits(segments, sides, size), "id", "left_anti")


def visible_knn(points: DataFrame, sides: DataFrame, k: int, size: float, cutoff: float = 250.0) -> DataFrame:
    """(src, dst, d2), both directions: each point's k nearest visible points within the least of cutoff and the distance of
    its k-th nearest. Each pair is tested once."""
    near = knn_join(points, points, k).where(F.col("d2") <= cutoff * cutoff)
    xy = lambda i, x, y: points.select(F.col("id").alias(i), F.col("x").alias(x), F.col("y").alias(y))
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "d2").distinct()
    seg = pairs.join(xy("a", "ax", "ay"), "a").join(xy("b", "bx", "by"), "b").withColumn("id", F.struct("a", "b"))
    seen = visible(seg, sides, size).select("a", "b", "d2")
    return seen.select(F.col("a").alias("src"), F.col("b").alias("dst"), "d2").union(seen.select(F.col("b").alias("src"), F.col("a").alias("dst"), "d2"))
