"""Layers to a graph to answers, end to end."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from wayfinder.functions.geometry import project, unproject
from wayfinder.operators.route import path_lengths
from wayfinder.plans.build import Navigator, build_graph, straight
from wayfinder.sources.features import from_geojson
from wayfinder.sources.files import path_map

X, Y = 648_000, 1_184_000


def test_build_and_navigate(spark, tmp_path):
    block = [[X + 40, Y + 40], [X + 60, Y + 40], [X + 60, Y + 60], [X + 40, Y + 60], [X + 40, Y + 40]]
    road = [[X + 10 * i, Y + 20] for i in range(11)]
    docs = [
        ("llyn_bygning_andre", json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [block]}, "properties": {}}, {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {}}]})),
        ("fortove", json.dumps({"features": [{"geometry": {"type": "LineString", "coordinates": road}, "properties": {}}, {"geometry": {"type": "LineString", "coordinates": [[X + 30, Y + 90], [X + 50, Y + 90], [X + 70, Y + 90]]}, "properties": {}}]})),
    ]
    network, sides = build_graph(from_geojson(spark.createDataFrame(docs, "layer string, json string")), size=10.0, k=6, cutoff=80.0)
    assert network.nodes.count() == 11 + 3 + 4 and sides.count() == 4
    names = spark.createDataFrame([("North gate", X + 50.0, Y + 90.0), ("South gate", X + 50.0, Y + 20.0)], "name string, x double, y double")
    nav = Navigator.of(network, sides, names)
    la, lo = unproject("x", "y")
    ends = spark.createDataFrame([(0, X + 50.0, Y + 19.0, X + 50.0, Y + 92.0)], "query_id long, sx double, sy double, tx double, ty double")
    q = ends.select("query_id", *[c.alias(n) for (x, y, a, b) in (("sx", "sy", "source_lat", "source_lon"), ("tx", "ty", "target_lat", "target_lon")) for c, n in zip(unproject(x, y), (a, b), strict=True)])
    line, rows = nav.route(q)
    line = line.cache()
    r = rows.first()
    assert r.length > straight(line).first().d + 3 and abs(path_lengths(line).first().length - r.length) < 1e-6  # around the block
    assert nav.health().first().nodes == 18 and nav.bounds().count() == 1
    found = nav.search(spark.createDataFrame([("GATE ",), ("none",)], "q string")).collect()
    assert {f.name for f in found} == {"North gate", "South gate"} and all(f.lat is not None for f in found)
    assert nav.by_labels(spark.createDataFrame([(1, "North gate", "South gate")], "query_id long, a string, b string")).first().d > 70
    away = spark.createDataFrame([(0, X + 100.0, Y + 60.0)], "query_id long, x double, y double").select("query_id", la.alias("lat"), lo.alias("lon"))
    now, fresh = nav.track(away, line.select("query_id", "seq", "x", "y"), spark.createDataFrame([(0, X + 50.0, Y + 92.0)], "query_id long, x double, y double"))
    assert now.first().off_route and fresh.count() > 2
    x, y = project("lat", "lon")
    first = fresh.orderBy("seq").select(x.alias("x"), y.alias("y")).first()
    assert abs(first.x - X - 100) < 0.01 and abs(first.y - Y - 60) < 0.01
    assert network.edges.where(F.col("w") <= 0).isEmpty()
    goals = spark.createDataFrame([(0, X + 50.0, Y + 92.0)], "query_id long, x double, y double")
    seen = []
    for k, (px, py) in enumerate([(X + 50.0, Y + 19.0), (X + 100.0, Y + 60.0)]):  # on the route, then away from it
        at = spark.createDataFrame([(0, k, px, py)], "query_id long, event_id long, x double, y double").select("query_id", "event_id", F.timestamp_seconds(F.lit(k)).alias("ts"), la.alias("lat"), lo.alias("lon"))
        at.coalesce(1).write.mode("append").parquet(str(tmp_path / "at"))
    stream = spark.readStream.schema(at.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "at"))
    nav.follow(stream, line, goals, lambda now, fresh, n: seen.append((n, now.first().off_route, fresh.count()))).awaitTermination()
    assert [x[:2] for x in seen] == [(0, False), (1, True)] and seen[0][2] == 0 and seen[1][2] > 2


def test_path_map(spark):
    import pytest

    paths = spark.createDataFrame([("a<b", 0, 1.0, 2.0), ("a<b", 1, 3.0, 5.0), ("c", 0, 0.0, 0.0)], "query_id string, seq int, x double, y double")
    page = path_map(paths, "T")
    assert page.count("<polyline") == 2 and "a&lt;b: 2 vertices" in page and "1.00,-2.00 3.00,-5.00" in page
    assert "<svg" in path_map(paths.limit(0))
    with pytest.raises(ValueError):
        path_map(paths, most=2)
