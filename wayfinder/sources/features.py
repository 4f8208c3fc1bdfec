"""Vector layers: GeoJSON to rows of geometry parts, and what is taken from them.

features(layer, feature_id, geom_type, props, parts); a part is a struct of its role (point, line, outer, hole) and points."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import RING, bbox, segment_boxes, square

PARTS = "array<struct<role:string,points:" + RING + ">>"
#: The layers of each role.
WALKABLE = (
    "eksisterende_haver eksisterende_torve forareal ldtu_parkering_sensade llyn_andre_arealer llyn_bro llyn_graes llyn_invasivearter llyn_parkering_areal llyn_torv_plads llyn_vejkant mellemareal parker fortove llyn_adgangsvej "
    "llyn_brandvej mobilitetsnetvaerkfodgaengercykel mobilitetsnetvaerkdrift mobilitetsnetvaerkbil"
).split()
OBSTACLES = "llyn_byggefelt_construction llyn_byggefelt_east llyn_bygning_andre llyn_bygning_dtu llyn_stoettemur".split()
OBSTACLES_WIDE = "llyn_byggefelt_100 llyn_byggefelt_75 llyn_byggefelt_construction llyn_byggefelt_east llyn_byggefelt_parkering llyn_byggeplads llyn_bygning_andre llyn_bygning_dtu llyn_stoettemur llyn_trae".split()
COLLECTION = "struct<features:array<struct<id:string,geometry:struct<type:string,coordinates:string,geometries:string>,properties:map<string,string>>>>"


def _xy(points: Column) -> Column:
    """x and y of [x, y, ...] arrays; further coordinates go."""
    return F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def _part(role: str, points: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), _xy(points).alias("points"))


def _rings(rings: Column) -> Column:
    return F.transform(rings, lambda r, i: F.struct(F.when(i == 0, "outer").otherwise("hole").alias("role"), _xy(r).alias("points")))


def parts(kind: Column, coordinates: Column) -> Column:
    """Parts of a geometry by its type and its coordinates as JSON; none for other types, null and empty coordinates."""
    deep = lambda n: F.from_json(coordinates, "array<" * n + "double" + ">" * n)
    # from_json wants a struct, array or map at the top: all of these are arrays
    none = F.array().cast(PARTS)
    found = (
        F.when(kind == "Point", F.array(_part("point", F.array(deep(1))))).when(kind == "MultiPoint", F.transform(deep(2), lambda p: _part("point", F.array(p)))).when(kind == "LineString", F.array(_part("line", deep(2))))
        .when(kind == "MultiLineString", F.transform(deep(3), lambda x: _part("line", x))).when(kind == "Polygon", _rings(deep(3))).when(kind == "MultiPolygon", F.flatten(F.transform(deep(4), _rings)))
    )
    return F.filter(F.coalesce(found, none), lambda p: (F.size(p["points"]) > 0) & F.get(p["points"], F.lit(0))["x"].isNotNull())


def from_geojson(documents: DataFrame) -> DataFrame:
    """Features of documents(layer, json), collections of geometries flattened; a document that isn't GeoJSON has none."""
    f = documents.select("layer", F.posexplode(F.from_json("json", COLLECTION)["features"]).alias("feature_id", "f"))
    own = F.struct(F.regexp_replace("f.geometry.type", " Z$", "").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))
    inner = F.from_json("f.geometry.geometries", "array<struct<type:string,coordinates:string>>")
    g = f.select("layer", F.col("feature_id").cast("long").alias("feature_id"), F.col("f.geometry.type").alias("geom_type"), F.col("f.properties").alias("props"), F.when(F.col("f.geometry.type") == "GeometryCollection", inner).otherwise(F.array(own)).alias("gs"))
    found = F.flatten(F.transform("gs", lambda x: parts(x["type"], x["coordinates"])))
    return g.select("layer", "feature_id", "geom_type", "props", F.coalesce(found, F.array().cast(PARTS)).alias("parts"))


def read_layers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Features of saved GeoJSON files by layer; layers whose file can't be read are left out."""
    out = None
    for layer, path in paths.items():
        try:
            one = spark.read.text(path, wholetext=True).select(F.lit(layer).alias("layer"), F.col("value").alias("json"))
        except Exception as e:  # a missing path: pyspark raises AnalysisException
            if type(e).__name__ != "AnalysisException":
                raise
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], "layer string, json string")
    return from_geojson(out)


def systems(documents: DataFrame) -> DataFrame:
    """(layer, crs) of documents(layer, json): the coordinate systems that they name, as authority:code, with the default of
    GeoJSON for those that name none."""
    name = F.get_json_object("json", "$.crs.properties.name")
    code = F.concat_ws(":", F.regexp_extract(name, "([A-Z]+):[^:]*:?([A-Za-z0-9]+)$", 1), F.regexp_extract(name, ":([A-Za-z0-9]+)$", 1))
    return documents.select("layer", F.when(name.isNull(), "OGC:CRS84").otherwise(code).alias("crs")).distinct()


class _Layer(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Layer(x.strip()) for x in self.options["layers"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        url = self.options["url"]
        if not url.startswith("file:"):
            query = {"service": "WFS", "version": "1.0.0", "request": "GetFeature", "typeName": partition.name, "outputFormat": "application/json"}
            url = f"{url}?{urllib.parse.urlencode(query)}"
        try:
            with urllib.request.urlopen(url.replace("{layer}", partition.name), timeout=60) as r:
                text = r.read().decode()
            json.loads(text)
        except (OSError, ValueError) as e:
            if self.options.get("skip", "false").lower() == "true":
                return
            raise OSError(f"layer {partition.name} can't be read: {e}") from e
        yield partition.name, text


class WfsSource(DataSource):
    """spark.read.format("wfs").option("url", ...).option("layers", "a,b"): a row (layer, json) and a task for each layer.

    A layer that can't be read fails the query, unless option skip is true: then it is left out."""

    @classmethod
    def name(cls) -> str:
        return "wfs"

    def schema(self) -> str:
        return "layer string, json string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WfsSource)


def of_role(features: DataFrame, role: str) -> DataFrame:
    return features.where(F.col("layer").isin({"walkable": WALKABLE, "obstacle": OBSTACLES, "obstacle_wide": OBSTACLES_WIDE}[role]))


def vertices(features: DataFrame) -> DataFrame:
    """(layer, x, y): the distinct vertices of each layer, holes too."""
    return features.select("layer", F.explode("parts").alias("p")).select("layer", F.explode("p.points").alias("v")).select("layer", "v.x", "v.y").dropDuplicates()


def polygons(features: DataFrame, half: float = 0.1) -> DataFrame:
    """(layer, feature_id, part, ring): outer rings, squares around points and boxes around the segments of lines."""
    p = features.select("layer", "feature_id", F.posexplode("parts").alias("part", "p"))
    ring = (
        F.when(F.col("p.role") == "outer", F.array(F.col("p.points"))).when(F.col("p.role") == "point", F.array(square(F.get("p.points", F.lit(0)), half))).when(F.col("p.role") == "line", segment_boxes(F.col("p.points"), half))
    )
    return p.select("layer", "feature_id", "part", F.explode(ring).alias("ring"))


def polylines(features: DataFrame) -> DataFrame:
    """(layer, feature_id, part, line): the lines."""
    p = features.select("layer", "feature_id", F.posexplode("parts").alias("part", "p"))
    return p.where("p.role = 'line'").select("layer", "feature_id", "part", F.col("p.points").alias("line"))


def without_low_points(points: DataFrame, x: float = 10_000, y: float = 10_000) -> DataFrame:
    """The points beyond both thresholds; both tests reach the scan."""
    return points.where((F.col("x") > x) & (F.col("y") > y))


def without_low_polygons(rings: DataFrame, x: float = 10_000, y: float = 10_000) -> DataFrame:
    b = bbox(F.col("ring"))
    return rings.where((b["minx"] > x) & (b["miny"] > y))


def surface_point(ring: Column) -> Column:
    """A point within a ring: the middle of the widest inner stretch at half its height.

    The library that this stands for may choose another point of the surface."""
    from ..functions.geometry import after, let

    def at(y: Column) -> Column:
        def cut(p: Column, i: Column) -> Column:
            q = after(ring, i)
            return F.when((p["y"] > y) != (q["y"] > y), p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"]))

        xs = F.sort_array(F.filter(F.transform(ring, cut), lambda x: x.isNotNull()))

        def widest(s: Column) -> Column:
            spans = F.filter(F.transform(s, lambda x, i: F.struct((F.get(s, i + 1) - x).alias("w"), ((F.get(s, i + 1) + x) / 2).alias("m"), (i % 2).alias("odd"))), lambda z: (z["odd"] == 0) & z["w"].isNotNull())
            return F.struct(F.array_max(spans)["m"].alias("x"), y.alias("y"))

        return let(xs, widest)

    ys = F.transform(ring, lambda p: p["y"])
    return let((F.array_min(ys) + F.array_max(ys)) / 2, at)


def building_points(features: DataFrame, key: str) -> DataFrame:
    """(number, x, y) of the features with a property `key`, at a point of their first outer ring."""
    outer = F.filter("parts", lambda p: p["role"] == "outer")
    p = features.where(F.col("props").getItem(key).isNotNull() & (F.size(outer) > 0)).select(F.col("props").getItem(key).alias("number"), surface_point(F.get(outer, F.lit(0))["points"]).alias("at"))
    return p.select("number", "at.x", "at.y")
