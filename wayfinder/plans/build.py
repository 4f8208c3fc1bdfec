"""From vector layers to a walkable graph, and from a graph to answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import after, offset_ring, project, squared, unproject
from ..operators import graph, joins, labels, merge, report, route, search
from ..operators.graph import SpatialGraph
from ..session import checkpoint, shared_folder
from ..sources import features as layers


def sides_of(rings: DataFrame) -> DataFrame:
    """(poly_id, i, ax, ay, bx, by) of rings(poly_id, ring), the closing side included."""
    ends = F.transform("ring", lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), after(F.col("ring"), i)["x"].alias("bx"), after(F.col("ring"), i)["y"].alias("by")))
    return rings.select("poly_id", F.posexplode(ends).alias("i", "s")).select("poly_id", "i", "s.*").where("ax <> bx OR ay <> by")


def obstacle_rings(features: DataFrame, low: float = 10_000) -> DataFrame:
    """(poly_id, ring) of the obstacle layers' geometries, without those near the origin."""
    p = layers.polygons(layers.of_role(features, "obstacle"))
    return layers.without_low_polygons(p, low, low).select(F.xxhash64("layer", "feature_id", "part", "ring").alias("poly_id"), "ring")


def _place_id(x: Column | str, y: Column | str) -> Column:
    return F.xxhash64(x, y)


def build_graph(features: DataFrame, size: float = 10.0, k: int = 32, offset: float = 1.5, cutoff: float = 250.0, low: float = 10_000) -> tuple[SpatialGraph, DataFrame]:
    """The largest component of the graph of obstacles' pushed-out corners, merged, and roads' vertices, each joined to its k
    nearest visible ones and along roads; and the obstacles' sides."""
    rings = checkpoint(obstacle_rings(features, low))
    sides = sides_of(rings)
    corners = rings.select("poly_id", F.posexplode(offset_ring(F.col("ring"), offset)).alias("i", "p")).select(F.xxhash64("poly_id", "i").alias("id"), "p.x", "p.y")
    roads = layers.polylines(layers.of_role(features, "walkable")).select(F.xxhash64("layer", "feature_id", "part").alias("line_id"), F.posexplode("line").alias("seq", "p")).select("line_id", "seq", "p.x", "p.y")
    places = merge.merge(corners, "dbscan").select("x", "y").union(layers.without_low_points(roads.select("x", "y"), low, low)).distinct()
    nodes = checkpoint(places.select(_place_id("x", "y").alias("id"), "x", "y"))
    near = joins.visible_knn(nodes, sides, k, size, cutoff).select("src", "dst", F.sqrt("d2").alias("w"))
    along = graph.polyline_edges(roads).select(_place_id("src_x", "src_y").alias("src"), _place_id("dst_x", "dst_y").alias("dst"), "w")
    edges = checkpoint(near.union(along).groupBy("src", "dst").agg(F.min("w").alias("w")))
    return graph.subgraph(SpatialGraph(nodes, edges), checkpoint(graph.largest_component(nodes, edges))), sides


@dataclass
class Navigator:
    """What the service answers from: a graph, obstacles' sides, landmark distances and place names."""

    graph: SpatialGraph
    sides: DataFrame
    landmarks: DataFrame
    points: DataFrame
    index: DataFrame
    size: float = 10.0

    @classmethod
    def of(cls, network: SpatialGraph, sides: DataFrame, names: DataFrame, size: float = 10.0) -> Navigator:
        """names(name, x, y)."""
        marks = checkpoint(search.landmark_distances(network.edges, search.select_landmarks(network.nodes)))
        return cls(network, sides, marks, checkpoint(labels.label_points(names, network.nodes)), checkpoint(labels.substring_index(names.select("name"))), size)

    def route(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Vertices and rows of queries(query_id, source_lat, source_lon, target_lat, target_lon)."""
        s, t = project("source_lat", "source_lon"), project("target_lat", "target_lon")
        asked = queries.select("query_id", s[0].alias("sx"), s[1].alias("sy"), t[0].alias("tx"), t[1].alias("ty"))
        return route.route(asked, self.graph.nodes, self.graph.edges, self.sides, self.size, self.landmarks)

    def track(self, positions: DataFrame, paths: DataFrame, goals: DataFrame, far: float = 20.0) -> tuple[DataFrame, DataFrame]:
        """The progress of positions(query_id, lat, lon) along paths(query_id, seq, x, y), and new routes' vertices from the
        positions further than `far` from their path to goals(query_id, x, y)."""
        x, y = project("lat", "lon")
        at = positions.select("query_id", x.alias("x"), y.alias("y"))
        now = checkpoint(route.split_progress(at, paths))
        stray = at.join(now.where(F.col("d") > far), "query_id", "left_semi")
        asked = stray.join(goals.select("query_id", F.col("x").alias("tx"), F.col("y").alias("ty")), "query_id").select("query_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "tx", "ty")
        fresh, _ = route.route(asked, self.graph.nodes, self.graph.edges, self.sides, self.size, self.landmarks)
        return now, fresh

    def follow(self, positions: DataFrame, paths: DataFrame, goals: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], far: float = 20.0):  # noqa: ANN201
        """A running query over the stream positions(query_id, event_id, ts, lat, lon): each micro-batch's last positions along
        their routes, and new routes to the same goals for those that strayed, which they follow from then on.

        sink gets the progress, the new routes' vertices and the batch's number. What it keeps of the vertices is what a
        restart takes as paths."""
        held = [paths.select("query_id", "seq", "x", "y")]

        def batch(df: DataFrame, number: int) -> None:
            last = df.groupBy("query_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "event_id")).alias("p")).select("query_id", "p.*")
            now, fresh = self.track(last, held[0], goals, far)
            fresh = checkpoint(fresh)
            kept = held[0].join(fresh.select("query_id").distinct(), "query_id", "left_anti")
            held[0] = checkpoint(kept.unionByName(fresh.select("query_id", "seq", "x", "y")))
            sink(now, fresh, number)

        place = f"{shared_folder(self.sides.sparkSession).rstrip('/')}/follow-{uuid.uuid4().hex}"
        return positions.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", place).start()

    def health(self) -> DataFrame:
        return graph.statistics(self.graph.nodes, self.graph.edges)

    def bounds(self) -> DataFrame:
        """The box of the nodes' latitudes (x) and longitudes (y)."""
        lat, lon = unproject("x", "y")
        return report.bounds(self.graph.nodes.select(lat.alias("x"), lon.alias("y")))

    def search(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """(q, name, rank, node, lat, lon) of queries(q); places are null where a name has no point."""
        lat, lon = unproject("x", "y")
        found = labels.suggest(queries, self.index, self.points, n)
        return found.join(self.graph.nodes.select(F.col("id").alias("node"), lat.alias("lat"), lon.alias("lon")), "node", "left").select("q", "name", "rank", "node", "lat", "lon")

    def by_labels(self, pairs: DataFrame) -> DataFrame:
        """Shortest paths between names: pairs(query_id, a, b) through the first rank at which both have a node."""
        at = self.points.join(self.graph.nodes.select(F.col("id").alias("node"), "x", "y"), "node").select("name", "rank", "x", "y")
        ends = labels.route_ends(pairs.select("a", "b").distinct(), at, self.points, self.graph.nodes)
        return search.alt_paths(self.graph.edges, pairs.join(ends, ["a", "b"]).select("query_id", "source", "target"), self.landmarks)


def straight(paths: DataFrame) -> DataFrame:
    """(query_id, d): the distance between a path's ends."""
    ends = paths.groupBy("query_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    return ends.select("query_id", F.sqrt(squared(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))).alias("d"))
