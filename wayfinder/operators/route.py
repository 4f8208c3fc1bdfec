"""Paths as lines: attaching points, stitching, projecting. Paths are paths(query_id, seq, x, y), seq from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import projection, squared, unproject
from ..session import checkpoint
from . import joins, search


def with_prefix(paths: DataFrame) -> DataFrame:
    """paths with step, the distance from the vertex before, and prefix, that from the first."""
    w = Window.partitionBy("query_id").orderBy("seq")
    step = F.coalesce(F.sqrt(squared(F.lag("x").over(w), F.lag("y").over(w), "x", "y")), F.lit(0.0))
    return paths.withColumn("step", step).withColumn("prefix", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def path_lengths(paths: DataFrame) -> DataFrame:
    return with_prefix(paths).groupBy("query_id").agg(F.sum("step").alias("length"), F.count("*").alias("nodes"))


def attach(points: DataFrame, paths: DataFrame, sides: DataFrame, size: float, radius: float = 40.0) -> DataFrame:
    """(query_id, seq, x, y, tier) of the vertex to which each of points(query_id, x, y) attaches.

    Of the vertices within the radius, the visible one with the least distance less progress (tier 0); if none is visible,
    the nearest of them (1); if none is that near, the nearest of all (2). Ties go to the first."""
    p = points.select("query_id", F.col("x").alias("px"), F.col("y").alias("py"))
    met = with_prefix(paths).join(p, "query_id").withColumn("far", F.sqrt(squared("px", "py", "x", "y")))
    near = met.where(F.col("far") <= radius)
    seg = near.select(F.struct("query_id", "seq").alias("id"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    hidden = joins.blocked(seg, sides, size).select("id.query_id", "id.seq", F.lit(True).alias("hidden"))
    ranked = met.join(hidden, ["query_id", "seq"], "left")
    within, seen = F.col("far") <= radius, F.col("hidden").isNull()
    tier = F.when(within & seen, 0).when(within, 1).otherwise(2)
    key = F.when(tier == 0, F.col("far") - F.col("prefix")).otherwise(F.col("far"))
    by = F.struct(tier.alias("tier"), key.alias("key"), "seq")
    return ranked.groupBy("query_id").agg(F.min_by(F.struct("seq", "x", "y", tier.alias("tier")), by).alias("v")).select("query_id", "v.*")


def continuous_paths(sources: DataFrame, targets: DataFrame, paths: DataFrame, sides: DataFrame, size: float, radius: float = 40.0) -> DataFrame:
    """(query_id, seq, x, y): from the source over the part of the path between both attachments to the target.

    The target attaches on the reversed path. If the attachments have crossed, the part runs backwards. Repeated vertices
    go. A query without a path gets the straight line."""
    last = paths.groupBy("query_id").agg(F.max("seq").alias("last"))
    backward = paths.join(last, "query_id").select("query_id", (F.col("last") - F.col("seq")).alias("seq"), "x", "y")
    start = attach(sources, paths, sides, size, radius).select("query_id", F.col("seq").alias("i"))
    end = attach(targets, backward, sides, size, radius).join(last, "query_id").select("query_id", (F.col("last") - F.col("seq")).alias("j"))
    part = paths.join(start, "query_id").join(end, "query_id").where(F.col("seq").between(F.least("i", "j"), F.greatest("i", "j")))
    middle = part.select("query_id", F.lit(1).alias("part"), F.when(F.col("i") <= F.col("j"), F.col("seq")).otherwise(-F.col("seq")).alias("k"), "x", "y")
    ends = lambda df, n: df.select("query_id", F.lit(n).alias("part"), F.lit(0).alias("k"), F.col("x"), F.col("y"))
    w = Window.partitionBy("query_id").orderBy("part", "k")
    full = ends(sources, 0).union(middle).union(ends(targets, 2)).withColumns({"lx": F.lag("x").over(w), "ly": F.lag("y").over(w)})
    kept = full.where("lx IS NULL OR x <> lx OR y <> ly")
    return kept.select("query_id", (F.row_number().over(w) - 1).alias("seq"), "x", "y")


def project_onto(points: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, seg, t, x, y, d): the nearest place on each point's path; of equals the first segment."""
    w = Window.partitionBy("query_id").orderBy("seq")
    seg = paths.select("query_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx IS NOT NULL")
    met = points.select("query_id", F.col("x").alias("px"), F.col("y").alias("py")).join(seg, "query_id").withColumn("t", projection("px", "py", "ax", "ay", "bx", "by"))
    met = met.withColumn("cx", F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).withColumn("cy", F.col("ay") + F.col("t") * (F.col("by") - F.col("ay")))
    met = met.withColumn("d", F.sqrt(squared("px", "py", "cx", "cy")))
    best = met.groupBy("query_id").agg(F.min_by(F.struct(F.col("seq").alias("seg"), "t", F.col("cx").alias("x"), F.col("cy").alias("y"), "d"), F.struct("d", "seq")).alias("b"))
    return best.select("query_id", "b.*")


def route(queries: DataFrame, nodes: DataFrame, edges: DataFrame, sides: DataFrame, size: float, landmarks: DataFrame | None = None, radius: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Routes of queries(query_id, sx, sy, tx, ty): their vertices (query_id, seq, x, y, lat, lon), and a row each of
    (query_id, source, target, graph_distance, length, visited). Queries without a way have no row.

    Queries with the same two places are routed once."""
    places = ["sx", "sy", "tx", "ty"]
    alone = checkpoint(queries.groupBy(*places).agg(F.min("query_id").alias("query_id")))
    same = queries.select(F.col("query_id").alias("asked"), *places).join(alone, places).select("asked", "query_id")
    queries = alone
    ends = {e: joins.nearest(queries.select(F.col("query_id").alias("id"), F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")), nodes).select(F.col("id").alias("query_id"), F.col("other").alias(n)) for e, n in (("s", "source"), ("t", "target"))}
    asked = ends["s"].join(ends["t"], "query_id")
    found = search.alt_paths(edges, asked, landmarks) if landmarks is not None else search.shortest_paths(edges, asked)
    found = checkpoint(found.where("path IS NOT NULL"))
    lines = search.path_nodes(found).join(nodes.select(F.col("id").alias("node"), "x", "y"), "node").select("query_id", "seq", "x", "y")
    point = lambda e: queries.join(found.select("query_id"), "query_id", "left_semi").select("query_id", F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y"))
    full = continuous_paths(point("s"), point("t"), lines, sides, size, radius)
    lat, lon = unproject("x", "y")
    rows = checkpoint(found.join(path_lengths(full).select("query_id", "length"), "query_id"))
    every = lambda df: df.join(same, "query_id").drop("query_id").withColumnRenamed("asked", "query_id")
    return every(full).select("query_id", "seq", "x", "y", lat.alias("lat"), lon.alias("lon")), every(rows).select("query_id", "source", "target", F.col("d").alias("graph_distance"), "length", "visited")


def recent(routes: DataFrame, n: int = 50) -> DataFrame:
    """The last n routes by id."""
    return routes.orderBy(F.desc("route_id")).limit(n)


def split_progress(positions: DataFrame, paths: DataFrame, stray: float = 10.0) -> DataFrame:
    """positions(query_id, x, y) along their paths: the nearest place, what is behind and ahead of it, and whether it strays."""
    at = project_onto(positions, paths)
    pre = with_prefix(paths)
    start = pre.select("query_id", F.col("seq").alias("seg"), F.col("prefix").alias("before"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    total = pre.groupBy("query_id").agg(F.max("prefix").alias("total"))
    done = F.col("before") + F.sqrt(squared("ax", "ay", "x", "y"))
    return at.join(start, ["query_id", "seg"]).join(total, "query_id").select("query_id", "seg", "t", "x", "y", "d", done.alias("traveled"), (F.col("total") - done).alias("remaining"), (F.col("d") > stray).alias("off_route"))
