"""Merging of points: grid, density clusters, greedy; densities and outliers."""

from __future__ import annotations

import heapq
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell
from ..session import checkpoint
from .graph import crowded, radius_components
from .joins import knn_join, radius_join


class Merge(Enum):
    """How points are merged."""

    NONE = "none"
    GRID = "grid"
    DBSCAN = "dbscan"


def grid_buckets(points: DataFrame, size: float = 5.0) -> DataFrame:
    return points.groupBy(cell("x", size).alias("cx"), cell("y", size).alias("cy")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def grid_merge(points: DataFrame, size: float = 10.0) -> DataFrame:
    """The mean of the points of each cell."""
    return grid_buckets(points, size).select("cx", "cy", "x", "y")


def dbscan_labels(points: DataFrame, eps: float, least: int, reference: bool = False) -> DataFrame:
    """(id, label): the least id of a core point of the cluster, -1 for noise.

    A core point has `least` points within eps, itself counted; in reference mode eps is squared and a point doesn't count
    itself. A border point joins the cluster with the least label among its core neighbours'."""
    radius = eps * eps if reference else eps
    core = checkpoint(points.join(crowded(points, radius, least - (0 if reference else 1), reference), "id", "left_semi").select("id", "x", "y"))
    label = checkpoint(radius_components(core, radius, reference).select(F.col("node").alias("id"), F.col("component").alias("label")))
    # points that aren't core are few in any cell, so their pairs are in proportion to points
    rest = points.join(core, "id", "left_anti")
    border = radius_join(rest, core, radius, reference).join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("border"))
    return points.select("id").join(label, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "border", F.lit(-1)).cast("long").alias("label"))


def dbscan_merge(points: DataFrame, eps: float, least: int, reference: bool = False) -> DataFrame:
    """(id, x, y): the mean of each cluster under its label, and the noise points as they are."""
    labelled = points.join(dbscan_labels(points, eps, least, reference), "id")
    means = labelled.where("label >= 0").groupBy(F.col("label").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return means.union(labelled.where("label < 0").select("id", F.col("x").cast("double"), F.col("y").cast("double")))


def greedy_merge(points: DataFrame, radius: float) -> DataFrame:
    """(id, x, y, n): in the order of ids, each point that no earlier one has absorbed absorbs all within the radius, absorbed
    or not, and becomes their mean.

    The absorbing points are those without an earlier absorbing neighbour, found in rounds: a point whose open neighbours
    all come later absorbs, its neighbours close."""
    pairs = checkpoint(radius_join(points, points, radius).select("id", "other"))
    open_, seeds = points.select("id"), None
    while True:
        live = pairs.join(open_, "id", "left_semi").join(open_.withColumnRenamed("id", "other"), "other", "left_semi")
        earlier = live.where("other < id").select("id").distinct()
        new = checkpoint(open_.join(earlier, "id", "left_anti"))
        seeds = new if seeds is None else seeds.union(new)
        gone = pairs.join(new, "id", "left_semi").select(F.col("other").alias("id")).union(new).distinct()
        open_ = checkpoint(open_.join(gone, "id", "left_anti"))
        if open_.isEmpty():
            break
    members = pairs.join(seeds, "id", "left_semi").union(seeds.select("id", F.col("id").alias("other")))
    at = points.select(F.col("id").alias("other"), "x", "y")
    return members.join(at, "other").groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def merge(points: DataFrame, how: Merge | str | None = None) -> DataFrame:
    """points merged by a strategy with its usual parameters: cells of 10, or clusters of eps 3 (squared) and one neighbour."""
    how = Merge.NONE if how is None else Merge(how)
    if how is Merge.GRID:
        g = grid_merge(points)
        return g.select(F.xxhash64("cx", "cy").alias("id"), "x", "y")
    return dbscan_merge(points, 3.0, 1, reference=True) if how is Merge.DBSCAN else points.select("id", "x", "y")


def density_grid(points: DataFrame, bins: int = 30) -> DataFrame:
    """(bx, by, n, density): a two-dimensional histogram over the points' bounds, last bins closed; density integrates to 1."""
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("total"))
    at = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) * bins / (F.col(hi) - F.col(lo))), F.lit(bins - 1)).cast("long")
    p = points.crossJoin(F.broadcast(b))  # b is one row
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (bins * bins)
    return p.groupBy(at("x", "x0", "x1").alias("bx"), at("y", "y0", "y1").alias("by")).agg(F.count("*").alias("n"), F.first(area * F.col("total")).alias("w")).select("bx", "by", "n", (F.col("n") / F.col("w")).alias("density"))


def without_outliers(points: DataFrame, radius: float = 500.0, least: int = 5) -> DataFrame:
    """The points with at least `least` points, themselves counted, within the radius."""
    return points.join(crowded(points, radius, least - 1), "id", "left_semi")


def _reachability(xy: np.ndarray, near: np.ndarray, least: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The order in which points are reached, and how far each was then: always the open point with the least
    max(core distance, distance) from a point before, of equals the first.

    near has the first neighbours of each point in positions, -1 for none. Each point that was reached waits in a heap with
    its next open neighbour; behind those it knows, it looks for the nearest open point in cells. Points are connected
    within `reach`, so none further than that, or than the greatest core distance, is ever next."""
    n = len(xy)
    if n < least:
        return np.arange(n), np.full(n, np.inf)
    known = near >= 0
    count = known.sum(axis=1)
    d = np.where(known, np.hypot(*(xy[near] - xy[:, None]).transpose(2, 0, 1)), np.inf)
    core = np.zeros(n) if least == 1 else np.partition(d, least - 2, axis=1)[:, least - 2] if near.shape[1] >= least - 1 else np.full(n, np.inf)
    for i in np.flatnonzero(~np.isfinite(core)):
        core[i] = np.partition(np.hypot(*(xy - xy[i]).T), least - 1)[least - 1]
    np.maximum(d, core[:, None], out=d)
    order = np.lexsort((near, d), axis=1)
    k, to, far = near.shape[1], np.take_along_axis(near, order, 1).ravel(), np.take_along_axis(d, order, 1).ravel()
    # others may be as far as the last of a list that lacks some
    limit = np.where(count < n - 1, np.where(known, np.take_along_axis(d, order, 1), 0.0).max(axis=1), np.inf)
    sure = (np.take_along_axis(d, order, 1) < limit[:, None]).sum(axis=1).tolist()
    del d, order, known
    most = max(reach, float(core.max()))

    low = xy.min(axis=0)
    side = max(float(np.sqrt(np.prod(np.maximum(np.ptp(xy, axis=0), 1e-9)) * 8 / n)), float(np.ptp(xy, axis=0).max()) / 2000, 1e-9)
    cell = ((xy - low) / side).astype(np.int64)
    wide = cell[:, 1].max() + 1
    by_cell = np.argsort(cell[:, 0] * wide + cell[:, 1], kind="stable")
    start = np.searchsorted((cell[:, 0] * wide + cell[:, 1])[by_cell], np.arange((cell[:, 0].max() + 1) * wide + 1))
    left = np.diff(start).reshape(-1, wide)
    done = np.zeros(n, bool)

    def held(i: int, r: int) -> np.ndarray:
        """The open points of the cells up to r from i's."""
        x, y = cell[i]
        some = np.flatnonzero(left[max(0, x - r) : x + r + 1, max(0, y - r) : y + r + 1])
        if not len(some):
            return some
        span = min(wide, y + r + 1) - max(0, y - r)
        c = (max(0, x - r) + some // span) * wide + max(0, y - r) + some % span
        deg = start[c + 1] - start[c]
        at = by_cell[np.arange(deg.sum()) + np.repeat(start[c] - np.cumsum(deg) + deg, deg)]
        return at[~done[at]]

    def look(i: int) -> tuple[float, int] | None:
        """The nearest open point of i, and how far it is."""
        r, last = 1, int(most / side) + 1
        while True:
            at = held(i, r)
            if len(at):
                v = np.maximum(np.hypot(*(xy[at] - xy[i]).T), core[i])
                if v.min() <= r * side or r >= last:
                    best = v.min()
                    return (float(best), int(at[v == best].min())) if best <= most else None
                r = min(last, max(r + 1, int(v.min() / side) + 1))
            elif r >= last:
                return None
            else:
                r = min(last, 2 * r)

    heap: list[tuple[float, int, int]] = []
    gone, at, to, far, limit = done.view(np.uint8).data, [0] * n, to.data, far.data, limit.data
    row, col = cell[:, 0].tolist(), cell[:, 1].tolist()

    def wait(i: int) -> None:
        """Puts i's next open neighbour, or what is known of how far it is, on the heap."""
        j, end = at[i], sure[i]
        while j < end and gone[to[i * k + j]]:
            j += 1
        at[i] = j
        if j < end:
            heapq.heappush(heap, (far[i * k + j], to[i * k + j], i))
        elif limit[i] < np.inf:
            heapq.heappush(heap, (limit[i], -1, i))

    run, r, first = [], [], 0
    while len(run) < n:
        if heap:
            v, j, i = heapq.heappop(heap)
            if j < 0 or gone[j]:
                if j >= 0 and at[i] < sure[i]:
                    wait(i)
                elif (found := look(i)) is not None:
                    heapq.heappush(heap, (*found, i))
                continue
        else:
            while gone[first]:
                first += 1
            v, j, i = np.inf, first, -1
        gone[j] = 1
        left[row[j], col[j]] -= 1
        run.append(j)
        r.append(v)
        wait(j)
        if i >= 0:
            if at[i] < sure[i]:
                wait(i)
            elif limit[i] < np.inf:
                heapq.heappush(heap, (v, -1, i))
    return np.array(run), np.array(r)


def optics_merge(points: DataFrame, least: int = 16, xi: float = 0.05, share: float = 0.01, reach: float = 50.0) -> DataFrame:
    """(id, x, y): means of clusters by ordering points by reachability, noise kept.

    The ordering is sequential, so each set of points connected within `reach` is ordered by itself, in one task, from its
    points' nearest neighbours; of equals the lesser id comes first. Clusters are the runs between rises of reachability by
    1 / (1 - xi) that hold `share` of all points and `least` of them."""
    label = radius_components(points, reach)
    total = points.count()
    need = max(least, int(share * total))
    near = knn_join(points, points, max(12, least)).groupBy("id").agg(F.collect_list("other").alias("near"))

    def order(p: pa.Table) -> pa.Table:
        lists = p["near"].combine_chunks()
        ids, x, y = p["id"].to_numpy(), p["x"].to_numpy().astype(float), p["y"].to_numpy().astype(float)
        by_id = np.argsort(ids, kind="stable")
        owner = np.repeat(np.argsort(by_id), lists.value_lengths().fill_null(0).to_numpy())
        ids, xy = ids[by_id], np.stack([x[by_id], y[by_id]], axis=1)
        other = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        owner, at = owner[ids[at] == other], at[ids[at] == other]  # what is in another component is too far
        deg = np.bincount(owner, minlength=len(ids))
        sort = np.argsort(owner, kind="stable")
        table = np.full((len(ids), max(1, deg.max())), -1)
        table[owner[sort], np.arange(len(sort)) - np.repeat(np.cumsum(deg) - deg, deg)] = at[sort]
        run, r = _reachability(xy, table, least, reach)
        n, cluster, begin, c = len(ids), np.full(len(ids), -1), 0, 0
        ends = np.flatnonzero((r[1:] > r[:-1] / (1 - xi)) & np.isfinite(r[:-1])) + 1
        for k in [*ends.tolist(), n]:
            if k - begin >= need:
                cluster[run[begin:k]] = c
                c += 1
            begin = k
        p = pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1], "cluster": cluster})
        means = p[p.cluster >= 0].groupby("cluster").agg(id=("id", "min"), x=("x", "mean"), y=("y", "mean"))
        return pa.Table.from_pandas(pd.concat([means, p[p.cluster < 0][["id", "x", "y"]]])[["id", "x", "y"]].astype({"id": "int64", "x": float, "y": float}), schema=schema, preserve_index=False)

    schema = pa.schema([("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])
    placed = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    grouped = placed.join(label.select(F.col("node").alias("id"), "component"), "id").join(near, "id", "left").groupBy("component")
    return grouped.applyInArrow(order, "id long, x double, y double")
