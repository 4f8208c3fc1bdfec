"""Place names: the nodes near them, and search by parts of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import box_match, knn_join

#: Characters by which names and queries are joined.
GRAM = 3


def last_of_each(labels: DataFrame) -> DataFrame:
    """The last, by order, of labels(name, x, y, order) of equal names."""
    return labels.groupBy("name").agg(F.max_by(F.struct("x", "y"), "order").alias("p")).select("name", "p.*")


def label_points(labels: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(name, rank, node, d2): the k nodes nearest to labels(name, x, y), rank 1 the nearest."""
    near = knn_join(labels.select(F.col("name").alias("id"), "x", "y"), nodes, k, with_self=True)
    return near.select(F.col("id").alias("name"), "rank", F.col("other").alias("node"), "d2")


def nested_labels(points: DataFrame) -> DataFrame:
    """(name, nodes): the nodes of each label from the furthest to the nearest."""
    return points.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node")), asc=False), lambda p: p["node"]).alias("nodes"))


def substring_index(names: DataFrame, lower: bool = True) -> DataFrame:
    """(substr, name) of every part of every name; lower-cased unless lower is off."""
    key = F.lower("name") if lower else F.col("name")
    n = F.length("name")
    cuts = names.where(n > 0).select("name", key.alias("key"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    parts = cuts.select("name", "key", "i", F.explode(F.sequence(F.lit(1), F.length("key") - F.col("i") + 1)).alias("n"))
    return parts.select(F.substring("key", F.col("i"), F.col("n")).alias("substr"), "name").distinct()


def suggest(queries: DataFrame, index: DataFrame, points: DataFrame, n: int = 5) -> DataFrame:
    """(q, name, rank, node) of queries(q): the first n names, in order, that hold the trimmed and lower-cased query; node is
    the label's nearest, null where there is none."""
    asked = queries.select("q", F.lower(F.trim("q")).alias("substr")).where("substr <> ''")
    by = Window.partitionBy("q").orderBy("name")
    top = asked.join(index, "substr").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    return top.join(points.where("rank = 1").select("name", "node"), "name", "left").select("q", "name", "rank", "node")


def contains(queries: DataFrame, names: DataFrame, n: int = 5) -> DataFrame:
    """(q, name, rank): the first n names that hold the query, letters' case apart; an empty query is in all names.

    Names meet queries over the query's first GRAM characters, or all if it has fewer, among their own runs of 1 to GRAM;
    only the names that share them are compared."""
    by = Window.partitionBy("q").orderBy("name")
    key = F.lower("name")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length(key) - 1, F.lit(0)))).alias("i")
    runs = names.select("name", at).select("name", F.explode(F.array(*[F.substring(key, F.col("i") + 1, F.lit(g)) for g in range(GRAM + 1)])).alias("run")).distinct()
    asked = queries.select("q", F.substring(F.lower("q"), 1, GRAM).alias("run"))
    met = asked.join(runs, "run").where(F.contains(key, F.lower("q")))
    return met.select("q", "name").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def route_ends(pairs: DataFrame, points: DataFrame, labelled: DataFrame, nodes: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(a, b, rank, source, target) of pairs(a, b) of names: the first rank at which both labels' points have a node within
    the tolerance; points(name, rank, x, y). Pairs without one have no row."""
    p = points.select(F.struct("name", "rank").alias("id"), "x", "y")
    hit = box_match(p, nodes, tolerance).select("id.name", "id.rank", F.col("other").alias("node"))
    side = lambda n, v: hit.select(F.col("name").alias(n), "rank", F.col("node").alias(v))
    both = pairs.join(side("a", "source"), "a").join(side("b", "target"), ["b", "rank"])
    return both.groupBy("a", "b").agg(F.min("rank").alias("rank"), F.min_by("source", "rank").alias("source"), F.min_by("target", "rank").alias("target"))
