"""Files: adjacency, labels and settings as JSON in, tables, JSON, CSV and GeoJSON out."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import SpatialGraph


def parse_adjacency(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(key, x, y) and edges(src, dst, w) by key of documents(json) of the form {"x,y": [[distance, [x, y]], ...]}."""
    entries = documents.select(F.explode(F.from_json("json", "map<string,array<string>>")).alias("key", "out"))
    at = F.split("key", ",")
    nodes = entries.select("key", at[0].cast("double").alias("x"), at[1].cast("double").alias("y")).distinct()
    pairs = entries.select("key", F.explode("out").alias("e")).select("key", F.from_json("e", "array<string>").alias("e"))
    end = F.from_json(F.col("e")[1], "array<double>")
    edges = pairs.select(F.col("key").alias("src"), end[0].alias("x"), end[1].alias("y"), F.col("e")[0].cast("double").alias("w"))
    named = nodes.select(F.col("key").alias("dst"), "x", "y")
    return nodes, edges.join(named, ["x", "y"]).select("src", "dst", "w")


def read_adjacency(spark: SparkSession, path: str) -> SpatialGraph:
    nodes, edges = parse_adjacency(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    ids = nodes.withColumn("id", F.xxhash64("key"))
    return SpatialGraph(ids.select("id", "x", "y"), edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), "w"))


def nested_adjacency(graph: SpatialGraph) -> DataFrame:
    """(key, out): each node with edges, by place, and its [distance, [x, y]] entries as JSON."""
    xy = lambda i: graph.nodes.select(F.col("id").alias(i), F.col("x").alias(f"{i}_x"), F.col("y").alias(f"{i}_y"))
    e = graph.edges.join(xy("src"), "src").join(xy("dst"), "dst")
    entry = F.concat(F.lit("["), F.col("w").cast("string"), F.lit(",["), F.col("dst_x").cast("string"), F.lit(","), F.col("dst_y").cast("string"), F.lit("]]"))
    return e.groupBy(F.concat_ws(",", "src_x", "src_y").alias("key")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("]")).alias("out"))


def write_adjacency(graph: SpatialGraph, path: str) -> None:
    """A line of JSON per node; all lines make the document of parse_adjacency."""
    line = F.concat(F.lit('{"'), "key", F.lit('":'), "out", F.lit("}"))
    nested_adjacency(graph).select(line.alias("value")).write.mode("overwrite").text(path)


def write_graph(graph: SpatialGraph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> SpatialGraph:
    return SpatialGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def read_points(spark: SparkSession, path: str) -> tuple[DataFrame | None, bool]:
    """The points of a file of JSON records, and whether it was there."""
    try:
        return spark.read.json(path, multiLine=True), True
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
        return None, False


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:  # noqa: ANN001
    """The table at path; built by build() and written there first if it is missing."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def settings(path: str) -> dict[str, bool | str]:
    """A JSON file of settings, with "true" and "false" as truth values."""
    read = json.loads(Path(path).read_text())
    return {k: v.lower() == "true" if isinstance(v, str) and v.lower() in ("true", "false") else v for k, v in read.items()}


def path_coordinates(paths: DataFrame) -> DataFrame:
    """Path vertices as they go to a CSV file: places with two decimals."""
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    return paths.select("algorithm", "type", F.col("seq").alias("point_index"), two("x").alias("x"), two("y").alias("y"))


def run_summary(runs: DataFrame) -> DataFrame:
    """runs(algorithm, type, nodes, d, visited, relaxed, heap_ops, time_ms) as they go to a CSV file; a path that isn't there
    costs inf."""
    cost = F.when(F.col("d").isNull(), "inf").otherwise(F.format_string("%.2f", F.col("d").cast("double")))
    names = {"nodes": "path_nodes", "visited": "nodes_visited", "relaxed": "edges_relaxed", "heap_ops": "heap_operations"}
    return runs.select("algorithm", "type", F.col("nodes").alias(names["nodes"]), cost.alias("distance"), *[F.col(c).alias(names[c]) for c in ("visited", "relaxed", "heap_ops")], F.format_string("%.3f", F.col("time_ms").cast("double")).alias("time_ms"))


def write_results(paths: DataFrame, runs: DataFrame, place: str) -> None:
    """Coordinates and summary as CSV with a header, and the runs as JSON, under place."""
    path_coordinates(paths).write.mode("overwrite").option("header", True).csv(f"{place}/path_coordinates")
    run_summary(runs).write.mode("overwrite").option("header", True).csv(f"{place}/algorithm_summary")
    runs.write.mode("overwrite").json(f"{place}/runs")


def write_catalogue(layers: DataFrame, place: str) -> None:
    """All layers by name, their short list, and a folder of layers for each category that has any."""
    from .catalog import categorized, simplified

    layers.orderBy("name").write.mode("overwrite").json(f"{place}/layers")
    simplified(layers).write.mode("overwrite").json(f"{place}/list")
    categorized(layers).write.mode("overwrite").partitionBy("category").json(f"{place}/categories")


def path_geojson(paths: DataFrame) -> DataFrame:
    """(query_id, geometry): each path as a GeoJSON line of longitudes and latitudes."""
    from ..functions.geometry import unproject

    lat, lon = unproject("x", "y")
    p = paths.select("query_id", F.struct("seq", F.array(F.round(lon, 6), F.round(lat, 6)).alias("at")).alias("v"))
    line = F.transform(F.array_sort(F.collect_list("v")), lambda v: v["at"])
    return p.groupBy("query_id").agg(F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))).alias("geometry"))


def path_map(paths: DataFrame, title: str = "Paths", most: int = 100_000) -> str:
    """A page that draws paths(query_id, seq, x, y), each in its own colour with its number of vertices.

    A map is for looking at: it raises beyond `most` vertices instead of drawing some."""
    rows = paths.select("query_id", "seq", "x", "y").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} vertices to draw")
    lines: dict = {}
    for r in sorted(rows, key=lambda r: (str(r.query_id), r.seq)):
        lines.setdefault(r.query_id, []).append((float(r.x), -float(r.y)))
    xs, ys = zip(*(p for line in lines.values() for p in line), strict=True) if rows else ((0.0,), (0.0,))
    wide, high = max(max(xs) - min(xs), 1.0), max(max(ys) - min(ys), 1.0)
    colour = lambda k: f"hsl({k * 137 % 360},70%,40%)"
    drawn = "".join(f'<polyline fill="none" stroke="{colour(k)}" points="{" ".join(f"{x:.2f},{y:.2f}" for x, y in line)}"/>' for k, line in enumerate(lines.values()))
    told = "".join(f'<li style="color:{colour(k)}">{html.escape(str(q))}: {len(line)} vertices</li>' for k, (q, line) in enumerate(lines.items()))
    box = f"{min(xs) - wide / 20:.2f} {min(ys) - high / 20:.2f} {wide * 1.1:.2f} {high * 1.1:.2f}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><svg viewBox="{box}" width="900" stroke-width="{max(wide, high) / 300:.3f}">{drawn}</svg><ul>{told}</ul></body></html>'
