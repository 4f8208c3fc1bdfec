"""Shortest paths for many queries at once.

Ways chosen by the number of edges. Up to SMALL_EDGES, the edges go to every task and the sources are what is distributed;
a task searches many at once over arrays, or each with a heap where steps have no length. Up to MIDDLE_EDGES, edges reach the
tasks by a shuffle: for sssp of few sources, and for pairs of source and target; if no ways are asked for, only distances,
there pairs aren't searched but got by separators. Beyond, one frontier holds all sources and moves by joins, three steps to
a checkpoint. All give the same distances; weights must not be negative. Unreached nodes have no row."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import squared
from ..session import checkpoint
from .joins import nearest
from .separators import FAR, PART, Separators, pieces

#: Directed edges that fit the driver and a task: 24 bytes each.
SMALL_EDGES = 2_000_000
#: Directed edges that fit a task which gets them by a shuffle.
MIDDLE_EDGES = 20_000_000
#: Sources of such searches.
FEW_SOURCES = 100
#: Distances that the searches of one batch hold in a task: 17 bytes each.
BATCH = 8_000_000
#: The same where edges come by a shuffle.
MIDDLE_BATCH = 12_000_000
#: Pairs of a task that are searched rather than got by separators.
FEW_PAIRS = 100
#: Numbers, of 4 bytes each, that separators hold for the ends of pairs at once.
ENDS_BATCH = 40_000_000


class _Adjacency:
    """Edges as arrays: the neighbours of the i-th node are to[start[i]:start[i + 1]]."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        self.names = np.union1d(src, dst)
        a, b = (np.searchsorted(self.names, x).astype(np.int32) for x in (src, dst))
        order = np.lexsort((b, a))
        self.to, self.w = b[order], w[order]
        self.start = np.searchsorted(a[order], np.arange(len(self.names) + 1))
        # no sum of lengths on a way is so long that adding a length leaves it as it is
        self.plain = not len(w) or bool(w.min() > 0 and w.min() * 2.0**40 > w.max() * len(self.names))

    def memo(self, name: str, make: Callable[[], object]) -> object:
        """make(), once in each worker."""
        kept = self.__dict__.setdefault("_kept", {})
        if name not in kept:
            kept[name] = make()
        return kept[name]

    def lists(self) -> tuple[list[int], list[float], list[int]]:
        """The arrays as lists, which loops read several times as fast."""
        return self.memo("lists", lambda: (self.to.tolist(), self.w.tolist(), self.start.tolist()))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def search(self, source: int, target: int | None = None, bound: float = math.inf, ahead: list[float] | None = None) -> tuple[dict[int, tuple[float, int]], int]:
        """{node: (distance, previous)} in positions, and how many nodes were settled; ends at the target, or at the bound.

        ahead holds a lower bound of each node's distance to the target. Of equally good ways to a node the one stands that
        ends in the fewest steps without length, then the lesser predecessor: so previous nodes never go round."""
        at = int(np.searchsorted(self.names, source))
        if at >= len(self.names) or self.names[at] != source:
            return {}, 0
        to, w, start = self.lists()
        best, done = {at: (0.0, 0, -1)}, set()
        heap = [(ahead[at] if ahead else 0.0, 0, at)]
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            u = pop(heap)[2]
            if u in done:
                continue
            done.add(u)
            if u == target:
                break
            d, z, _ = best[u]
            for k in range(start[u], start[u + 1]):
                v = to[k]
                if v in done:
                    continue
                new = d + w[k]
                old = best.get(v)
                if new > bound or (old is not None and new > old[0]):
                    continue
                reach = (new, z + 1 if new == d else 0, u)
                if old is None or reach < old:
                    best[v] = reach
                    push(heap, (new + ahead[v] if ahead else new, reach[1], v))
        return {v: (d, p) for v, (d, _, p) in best.items() if target is None or v in done}, len(done)


    def back(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges by their ends: the i-th node's predecessors, in order, are the first array's [third[i]:third[i + 1]]."""

        def make() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            src = np.repeat(np.arange(len(self.names), dtype=np.int32), np.diff(self.start))
            order = np.lexsort((src, self.to))
            return src[order], self.w[order], np.searchsorted(self.to[order], np.arange(len(self.names) + 1))

        return self.memo("back", make)

    def many(self, source: np.ndarray, target: np.ndarray, ahead: Bound | None = None, both: bool = False, most: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Searches in positions at once: distances (a row for each search, then with both a row for each from its target),
        the targets' distances, and how many nodes each search has expanded.

        Nodes are expanded by buckets of their key, the distance plus a lower bound of the rest less that of the whole, all
        searches' nodes of a bucket together and again while they improve in it: so searches of any length go side by side. A
        search ends behind the bucket of its target. Target -1: none.
        With both, keys have the potential (h(v, target) - h(v, source)) / 2, and a search ends when the least keys of its two
        sides add up to the best meeting."""
        n, q = len(self.names), len(source)
        begin, end = (np.concatenate([source, target]), np.concatenate([target, source])) if both else (source, target)
        dist, queued, first = np.full(len(begin) * n, np.inf), np.full(len(begin) * n, -1, np.int32), np.empty(len(begin) * n, np.int32)
        seen = np.zeros(len(begin) * n, bool)
        at = np.arange(len(begin)) * n + begin
        dist[at] = 0.0
        size = float(self.w.min() if ahead is None else self.w.mean() / 4 if both else self.w.mean()) if len(self.w) else 1.0
        goal, aim = np.arange(len(begin)) * n + end, np.where(end >= 0, end, begin)
        led = None if ahead is None else ahead.chosen(source, target) if isinstance(ahead, _Landmarks) else lambda v, t, _: ahead(v, t)
        top, shift = np.full(q, np.inf), led(source, aim[:q], np.arange(q)) if led is not None else np.zeros(q)
        rest = led(begin, end, np.arange(len(begin)) % q) / 2 if both and led is not None else None

        def left(row: np.ndarray) -> np.ndarray:
            """The greatest key of use to a search."""
            return (top[row % q] - shift[row % q]) / 2 if both else np.minimum(most, np.where(end[row] >= 0, dist[goal[row]], np.inf)) - shift[row]

        pending: dict[int, list[np.ndarray]] = {0: [at]}
        queued[at] = 0
        while pending:
            k = min(pending)
            at = np.concatenate(pending.pop(k))
            at = at[queued[at] == k]
            row = at // n
            live = k * size <= left(row) * (1 + 1e-12) + 1e-9
            at, row = at[live], row[live]
            if not len(at):
                continue
            queued[at], seen[at] = -1, True
            v = at - row * n
            deg = self.start[v + 1] - self.start[v]
            edge = np.arange(deg.sum()) + np.repeat(self.start[v] - np.cumsum(deg) + deg, deg)
            new = np.repeat(dist[at], deg) + self.w[edge]
            to = np.repeat(row * n, deg) + self.to[edge]
            good = new < dist[to]
            if most < math.inf:
                good &= new <= most
            to, new = to[good], new[good]
            np.minimum.at(dist, to, new)
            good = dist[to] == new
            to, new = to[good], new[good]
            first[to] = np.arange(len(to), dtype=np.int32)
            good = first[to] == np.arange(len(to))
            to, new = to[good], new[good]
            row = to // n
            v = to - row * n
            key = new
            if both:
                np.minimum.at(top, row % q, new + dist[(row + q) % (2 * q) * n + v])
            if led is not None:
                key = new + (led(v, aim[row], row % q) - led(v, begin[row], row % q)) / 2 - rest[row] if both else new + led(v, aim[row], row) - shift[row]
            good = key <= left(row) * (1 + 1e-12) + 1e-9 if not both else np.isfinite(key)
            to, bucket = to[good], np.maximum(key[good] / size, k).astype(np.int32)
            fresh = queued[to] != bucket
            to, bucket = to[fresh], bucket[fresh]
            queued[to] = bucket
            if len(to):
                order = np.argsort(bucket, kind="stable")
                to, bucket = to[order], bucket[order]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                for part, b in zip(np.split(to, cut), bucket[np.r_[0, cut]].tolist(), strict=True):
                    pending.setdefault(b, []).append(part)
        expanded = seen.reshape(-1, n).sum(axis=1)
        return dist.reshape(-1, n), top if both else np.where(end >= 0, dist[goal], np.inf), expanded[:q] + expanded[q:] if both else expanded

    def ways(self, dist: np.ndarray, row: np.ndarray, end: np.ndarray, begin: np.ndarray) -> list[list[int]]:
        """The names on the ways from begin to end by the rows of distances; of equally good predecessors the lesser."""
        src, w, start = self.back()
        steps, at, on = [end], end.copy(), np.flatnonzero(end != begin)
        while len(on):
            v, deg = at[on], start[at[on] + 1] - start[at[on]]
            cuts = np.cumsum(deg) - deg
            edge = np.arange(deg.sum()) + np.repeat(start[v] - cuts, deg)
            u = src[edge]
            d = dist[np.repeat(row[on], deg), u] + w[edge]
            best = np.repeat(np.minimum.reduceat(d, cuts), deg)
            at[on] = np.minimum.reduceat(np.where(d == best, u, len(self.names)), cuts)
            step = np.full(len(at), -1)
            step[on] = at[on]
            steps.append(step)
            on = on[at[on] != begin[on]]
        table = np.stack(steps[::-1], axis=1)
        return [self.names[line[line >= 0]].tolist() for line in table]

    def previous(self, dist: np.ndarray, begin: int) -> np.ndarray:
        """Each node's predecessor by one row of distances, of equals the lesser; -1 at the beginning and where it isn't reached."""
        src, w, start = self.back()
        out, deg = np.full(len(self.names), -1), np.diff(start)
        some = np.flatnonzero(deg)
        if len(some):
            d = dist[src] + w
            best = np.repeat(np.minimum.reduceat(d, start[some]), deg[some])
            out[some] = np.minimum.reduceat(np.where(d == best, src, len(self.names)), start[some])
        out[~np.isfinite(dist)] = -1
        out[begin] = -1
        return out


class _Landmarks:
    """The greatest difference of distances to a landmark that both reach, of a table with a row for each node."""

    #: Landmarks that a search uses, the best of its two ends.
    EACH = 4

    def __init__(self, table: np.ndarray) -> None:
        self.table = np.ascontiguousarray(table)

    def __call__(self, v: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(v.shape, t.shape))
        for c in self.table.T:
            np.fmax(out, np.abs(c[v] - c[t]), out=out)
        return out

    def chosen(self, source: np.ndarray, target: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """The bound by the landmarks that are best for each search from source to target; its third argument says which search."""
        wide, flat = self.table.shape[1], self.table.ravel()
        gap = np.nan_to_num(np.abs(self.table[source] - self.table[target]), nan=-1.0)
        best = np.argsort(-gap, axis=1, kind="stable")[:, : self.EACH].T.copy()

        def bound(v: np.ndarray, t: np.ndarray, row: np.ndarray) -> np.ndarray:
            out, a, b = np.zeros(len(v)), v * wide, t * wide
            for c in best:
                np.fmax(out, np.abs(flat[a + c[row]] - flat[b + c[row]]), out=out)
            return out

        return bound


#: Lower bounds of the distances of nodes to targets, both in positions, one by one.
Bound = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Gives them for the names of a graph's nodes.
Ahead = Callable[[np.ndarray], Bound]


class _Table:
    """Lower bounds made from a table, which is collected only for a search in one task, and only for that graph's nodes."""

    def __init__(self, table: DataFrame, node: str, make: Callable[[pd.DataFrame], Ahead]) -> None:
        self.table, self.node, self.make = table, node, make

    def of(self, spark: SparkSession, names: np.ndarray) -> Ahead:
        table = checkpoint(self.table)
        if table.limit(SMALL_EDGES + 1).count() > SMALL_EDGES:
            table = table.join(spark.createDataFrame(pd.DataFrame({self.node: names})), self.node, "left_semi")
        return self.make(table.toArrow().to_pandas())


def gathered(edges: DataFrame) -> DataFrame | _Adjacency:
    """edges in a form that several calls of the searches can use, collected once if they are few."""
    graph = _small(edges)
    return edges if graph is None else graph


def _small(edges: DataFrame) -> _Adjacency | None:
    """The edges in arrays, if there are few enough."""
    if edges.limit(SMALL_EDGES + 1).count() > SMALL_EDGES:
        return None
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double")).toArrow()
    return _Adjacency(*(e[c].to_numpy() for c in ("src", "dst", "w")))


def sssp(edges: DataFrame, sources: DataFrame, bound: float | None = None, distributed: bool | None = None) -> DataFrame:
    """(source, node, d, prev) for every node that a source of sources(source) reaches, within bound if there is one.

    prev is null at the source. Of equally good predecessors it is the one with the fewest steps without length at the end of
    its way, then the lesser, so that following it always ends at the source."""
    graph = None if distributed else _small(edges)
    if graph is not None:
        return _local(graph, sources, bound)
    few = [] if distributed else [r.source for r in sources.select("source").distinct().limit(FEW_SOURCES + 1).collect()]
    if 0 < len(few) <= FEW_SOURCES and edges.limit(MIDDLE_EDGES + 1).count() <= MIDDLE_EDGES:
        return _middle(edges, few, bound)
    return _loop(edges, sources, bound)


def _local(graph: _Adjacency, sources: DataFrame, bound: float | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _trees(graph, batch["source"].to_numpy(np.int64), bound)

    return _dealt(sources.select("source").distinct(), "source").mapInPandas(run, "source long, node long, d double, prev long")


def _trees(graph: _Adjacency, sources: np.ndarray, bound: float | None) -> Iterator[pd.DataFrame]:
    """sssp's rows of each source."""
    most = math.inf if bound is None else bound

    def rows(s: int, nodes: np.ndarray, d: np.ndarray, prev: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"source": s, "node": graph.names[nodes], "d": d, "prev": pd.arrays.IntegerArray(graph.names[np.maximum(prev, 0)].astype(np.int64), prev < 0)})

    if not graph.plain:
        for s in sources:
            found, _ = graph.search(int(s), bound=most)
            nodes = np.array(sorted(found), np.int64)
            yield rows(s, nodes, np.array([found[v][0] for v in nodes], float), np.array([found[v][1] for v in nodes], np.int64))
        return
    at = np.array([_place(graph, int(s)) for s in sources], np.int64)
    sources, at = sources[at >= 0], at[at >= 0]
    for some in _batches(graph, len(at)):
        dist, _, _ = graph.many(at[some], np.full(len(at[some]), -1), most=most)
        for s, begin, d in zip(sources[some], at[some], dist, strict=True):
            nodes = np.flatnonzero(np.isfinite(d))
            yield rows(s, nodes, d[nodes], graph.previous(d, begin)[nodes])


def _batches(graph: _Adjacency, n: int, rows: int = 1, most: int = BATCH) -> Iterator[slice]:
    """Slices of n searches that hold some `most` distances, each having that many rows of them."""
    step = min(256, max(1, most // (rows * max(1, len(graph.names)))))
    return (slice(i, i + step) for i in range(0, n, step))


def _middle(edges: DataFrame, sources: list[int], bound: float | None, each: int = 16) -> DataFrame:
    """sssp of a few sources, where a task for `each` of them gets all edges by a shuffle, and none pass the driver."""
    n = max(1, math.ceil(len(sources) / each))
    copies = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"), F.explode(F.array(*map(F.lit, range(n)))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, parts, first = [], set(), None
        for batch in batches:
            part = batch["part"].to_numpy()
            parts |= set(np.unique(part).tolist())
            first = part[0] if first is None else first  # a task may get several copies and needs one
            kept.append([batch[c].to_numpy()[part == first] for c in ("src", "dst", "w")])
        if kept:
            graph = _Adjacency(*(np.concatenate([x[i] for x in kept]) for i in range(3)))
            del kept
            for p in _trees(graph, np.array([s for i, s in enumerate(sources) if i % n in parts], np.int64), bound):
                yield pa.RecordBatch.from_pandas(p, schema, preserve_index=False)

    schema = pa.schema([("source", pa.int64()), ("node", pa.int64()), ("d", pa.float64()), ("prev", pa.int64())])
    return copies.repartition(n, "part").mapInArrow(run, "source long, node long, d double, prev long")


def _loop(edges: DataFrame, sources: DataFrame, bound: float | None, steps: int = 3) -> DataFrame:
    """sssp by joins: one frontier for all sources. z counts the steps without length that end a way."""
    edges = checkpoint(edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    state = frontier = checkpoint(sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("z"), F.lit(None).cast("long").alias("prev")))
    order = F.struct("d", "z", F.coalesce("prev", F.lit(-(2**63)).cast("long")).alias("p"), "prev")
    columns = ["source", "node", "best.d", "best.z", "best.prev"]
    while not frontier.isEmpty():
        new = reached = frontier
        for _ in range(steps):
            d = F.col("d") + F.col("w")
            new = new.join(edges, new["node"] == edges["src"]).select("source", F.col("dst").alias("node"), d.alias("d"), F.when(d == F.col("d"), F.col("z") + 1).otherwise(0).alias("z"), F.col("node").alias("prev"))
            if bound is not None:
                new = new.where(F.col("d") <= bound)
            new = new.groupBy("source", "node").agg(F.min(order).alias("best")).select(*columns)
            reached = reached.union(new)
        both = state.withColumn("old", F.lit(True)).unionByName(reached.withColumn("old", F.lit(False)))
        both = both.groupBy("source", "node").agg(F.min(order).alias("best"), F.min(F.when(F.col("old"), order)).alias("had"))
        merged = checkpoint(both.select(*columns, (F.col("had").isNull() | (F.col("best") < F.col("had"))).alias("better")))
        state = merged.drop("better")
        frontier = merged.where("better").drop("better")
    return state.drop("z")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over twice as many partitions as there are cores. The hash keeps Spark from taking the exchange of a distinct()
    by the same columns for this one, and then coalescing it to one task."""
    return rows.repartition(2 * max(1, rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64(*by))


Found = tuple[float | None, list[int] | None, int | None]


def apart(edges: DataFrame | _Adjacency, queries: DataFrame) -> DataFrame | None:
    """(query_id, source, target, d) of queries, once for searches of any kind, where the edges are so many that distances
    without ways come by separators; else None. gathered() says first which edges are few."""
    if isinstance(edges, _Adjacency) or edges.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES or edges.limit(MIDDLE_EDGES + 1).count() > MIDDLE_EDGES:
        return None
    return checkpoint(shortest_paths(edges, queries, paths=False).select("query_id", "source", "target", "d"))


def _pairs(edges: DataFrame | _Adjacency, queries: DataFrame, ahead: Ahead | _Table | None, both: bool, one: Callable[[Ahead | None, _Adjacency, int, int], Found], paths: bool = True) -> DataFrame:
    """The queries' searches in batches; by `one` each where there are ways without length. Without paths, path and visited
    may be null."""
    graph = edges if isinstance(edges, _Adjacency) else _small(edges)
    if graph is None and edges.limit(MIDDLE_EDGES + 1).count() <= MIDDLE_EDGES:
        return _shuffled(edges, queries, ahead is not None, both, one, paths)
    if graph is None:
        return _far(edges, queries)
    made = ahead.of(queries.sparkSession, graph.names) if isinstance(ahead, _Table) else ahead

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = list(zip(batch["query_id"], batch["source"], batch["target"], strict=True))
            if graph.plain:
                found = (x for some in _batches(graph, len(asked), 1 + both) for x in _answer(graph, [(int(s), int(t)) for _, s, t in asked[some]], made, both))
            else:
                found = (one(made, graph, int(s), int(t)) for _, s, t in asked)
            yield pd.DataFrame([(*q, *x) for q, x in zip(asked, found, strict=True)], columns=["query_id", "source", "target", "d", "path", "visited"])

    dealt = _dealt(queries.select("query_id", "source", "target"), "query_id", "source", "target")
    return dealt.mapInPandas(run, "query_id long, source long, target long, d double, path array<long>, visited long")


def _answer(graph: _Adjacency, asked: list[tuple[int, int]], ahead: Ahead | None, both: bool) -> list[Found]:
    """d, path and visited of pairs of source and target, searched together."""
    ends = [(_place(graph, s), _place(graph, t)) for s, t in asked]
    out: list[Found] = [(0.0, [s], 1) if s == t else (None, None, 0) for s, t in asked]
    open_ = [i for i, (s, t) in enumerate(asked) if s != t and ends[i][0] >= 0 and (ends[i][1] >= 0 or not both)]
    if not open_:
        return out
    a, b = np.array([ends[i] for i in open_], np.int64).T
    bound = graph.memo("ahead", lambda: ahead(graph.names)) if ahead is not None else None
    dist, d, visited = graph.many(a, b, bound, both)
    good = np.flatnonzero(np.isfinite(d))
    row = np.arange(len(a))
    if both:
        meet = np.array([(dist[i] + dist[len(a) + i]).argmin() for i in good], np.int64)
        there, back = graph.ways(dist, row[good], meet, a[good]), graph.ways(dist, row[good] + len(a), meet, b[good])
        paths = [x + y[-2::-1] if len(y) > 1 else x for x, y in zip(there, back, strict=True)]
    else:
        paths = graph.ways(dist, row[good], b[good], a[good]) if len(good) else []
        if bound is None:  # a heap settles equally far nodes in order
            visited = np.array([np.isfinite(x).sum() if not np.isfinite(y) else (x < y).sum() + (x[: t + 1] == y).sum() for x, y, t in zip(dist, d, b, strict=True)])
    for i, x in enumerate(open_):
        out[x] = (None, None, int(visited[i]))
    for i, path in zip(good, paths, strict=True):
        out[open_[i]] = (float(d[i]), path, int(visited[i]))
    return out


def _own_landmarks(graph: _Adjacency, n: int = 16) -> Ahead | None:
    """Bounds by n nodes far from each other; none where an edge has no equal back."""
    src, w, _ = graph.back()
    if not np.array_equal(src, graph.to) or not np.array_equal(w, graph.w):
        return None
    at, near, columns = 0, np.full(len(graph.names), np.inf), []
    for k in range(n + 1):  # the first only finds a far node
        d = graph.many(np.array([at]), np.array([-1]))[0][0]
        if k:
            columns.append(np.where(np.isfinite(d), d, np.nan))
        near = np.minimum(near, d) if k else d
        at = int(near.argmax())
    table = np.stack(columns, axis=1)
    return lambda names: _Landmarks(table)


def _whole(graph: _Adjacency) -> bool:
    """Has each edge an equal back, and a whole length of 32 bits at most?"""
    src, w, _ = graph.back()
    same = np.array_equal(src, graph.to) and np.array_equal(w, graph.w)
    del graph._kept["back"]
    return same and bool(graph.w.max() < FAR and (graph.w == np.floor(graph.w)).all())


def _apart(graph: _Adjacency, asked: list[tuple[int, int]], large: int = 16) -> list[Found | None] | None:
    """The distances of pairs of source and target by separators, without ways and counts; None for a pair that must be
    searched, and for all where the graph isn't fit for it.

    Near nodes are told by their distances from four of a component's nodes that are far from each other, for some `large`
    components."""
    if not graph.plain or not len(graph.to) or not _whole(graph):
        return None
    piece = pieces(graph.start, graph.to)
    heads, sizes = np.unique(piece, return_counts=True)
    u, v = np.zeros(len(piece), np.float32), np.zeros(len(piece), np.float32)
    for head in heads[np.argsort(-sizes, kind="stable")[:large]][np.sort(-sizes)[:large] < -PART]:
        mine = np.flatnonzero(piece == head)
        far = lambda at: graph.many(np.array([mine[at]]), np.array([-1]))[0][0][mine]
        a = far(far(0).argmax())
        b = far(a.argmax())
        c = far((a + b - 2 * np.abs(a - b)).argmax())
        d = far((c - np.abs(a - b)).argmax())
        u[mine], v[mine] = a - b, c - d
    ends = np.array([(_place(graph, s), _place(graph, t)) for s, t in asked], np.int64).reshape(-1, 2)
    open_ = np.flatnonzero((ends >= 0).all(axis=1))
    open_ = open_[piece[ends[open_, 0]] == piece[ends[open_, 1]]]
    by = Separators(graph.start, graph.to, graph.w, [piece, u, v, u + v, u - v])
    top = by.parts(np.arange(len(piece)))
    if top is None:
        return None
    out: list[Found | None] = [(0.0 if s == t else None, None, None) for s, t in asked]
    step = max(1, ENDS_BATCH // (2 * max(1, by.widest)))
    for some in (open_[i : i + step] for i in range(0, len(open_), step)):
        for i, d in zip(some.tolist(), by.distances(top, *ends[some].T).tolist(), strict=True):
            out[i] = (float(d), None, None) if d < FAR else None
    return out


def _shuffled(edges: DataFrame, queries: DataFrame, guided: bool, both: bool, one: Callable[[Ahead | None, _Adjacency, int, int], Found], paths: bool = True) -> DataFrame:
    """_pairs where each core's task gets all edges and its share of the queries by a shuffle, and none pass the driver.

    Guided searches take the bounds of landmarks that each task finds by itself, which need no table in every task."""
    n, few = max(1, queries.sparkSession.sparkContext.defaultParallelism), FEW_PAIRS
    long = lambda c, name: F.col(c).cast("long").alias(name)
    part = F.pmod(F.xxhash64("query_id", "source", "target"), F.lit(n))
    asked = queries.select(long("source", "src"), long("target", "dst"), F.lit(None).cast("double").alias("w"), long("query_id", "query_id"), part.cast("int").alias("part"))
    copies = edges.select(long("src", "src"), long("dst", "dst"), F.col("w").cast("double").alias("w"), F.lit(None).cast("long").alias("query_id"), F.explode(F.array(*map(F.lit, range(n)))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, mine = [], []
        for batch in batches:
            ask = batch["query_id"].is_valid()
            mine += [tuple(x.values()) for x in batch.filter(ask).select(["query_id", "src", "dst"]).to_pylist()]
            way = batch.filter(pc.invert(ask))
            kept.append([way[c].to_numpy(zero_copy_only=False) for c in ("src", "dst", "w")])
        if not mine:
            return
        columns = [np.concatenate([x.pop(0) for x in kept]) for _ in range(3)]
        graph = _Adjacency(*columns)
        del kept, columns
        pairs = [(s, t) for _, s, t in mine]
        known = None if paths or len(pairs) <= few else _apart(graph, pairs)
        rest = list(range(len(mine))) if known is None else [i for i, x in enumerate(known) if x is None]
        if known is not None:
            yield batch_of([(*q, *x) for q, x in zip(mine, known, strict=True) if x is not None])
        made = _own_landmarks(graph) if guided and graph.plain and rest else None
        for some in _batches(graph, len(rest), 1 + both, MIDDLE_BATCH):
            ask = [pairs[i] for i in rest[some]]
            found = _answer(graph, ask, made, both) if graph.plain else [one(None, graph, s, t) for s, t in ask]
            yield batch_of([(*mine[i], *x) for i, x in zip(rest[some], found, strict=True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("query_id", "source", "target")] + [("d", pa.float64()), ("path", pa.list_(pa.int64())), ("visited", pa.int64())])
    return asked.union(copies).repartitionById(n, F.col("part")).mapInArrow(run, "query_id long, source long, target long, d double, path array<long>, visited long")


def _far(edges: DataFrame, queries: DataFrame, steps: int = 3) -> DataFrame:
    """_pairs by joins: one frontier holds all pairs of source and target, and what is no nearer than the best way to the
    target so far goes no further. visited counts the nodes no further from the source than the target, or all reached.

    z counts the steps without length that lead to a node, so that going back along prev never goes round."""
    key = ["source", "target"]
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), *[F.col(c).cast("long").alias(c) for c in key])
    edges = checkpoint(edges.groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    names = edges.select(F.col("src").alias("source")).union(edges.select("dst")).distinct()
    first = asked.where("source <> target").select(*key).distinct().join(names, "source", "left_semi").select(*key, F.col("source").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("z"), F.lit(None).cast("long").alias("prev"))
    order = F.struct("d", "z", F.coalesce("prev", F.lit(-(2**63)).cast("long")).alias("p"), "prev")
    columns = [*key, "node", "best.d", "best.z", "best.prev"]
    state = frontier = checkpoint(first)
    while not frontier.isEmpty():
        new = reached = frontier
        for _ in range(steps):
            d = F.col("d") + F.col("w")
            new = new.join(edges, new["node"] == edges["src"]).select(*key, F.col("dst").alias("node"), d.alias("d"), F.when(d == F.col("d"), F.col("z") + 1).otherwise(0).alias("z"), F.col("node").alias("prev"))
            new = new.groupBy(*key, "node").agg(F.min(order).alias("best")).select(*columns)
            reached = reached.union(new)
        both = state.withColumn("old", F.lit(True)).unionByName(reached.withColumn("old", F.lit(False)))
        both = both.groupBy(*key, "node").agg(F.min(order).alias("best"), F.min(F.when(F.col("old"), order)).alias("had"))
        merged = checkpoint(both.select(*columns, (F.col("had").isNull() | (F.col("best") < F.col("had"))).alias("better")))
        state = merged.drop("better")
        frontier = merged.where("better").drop("better").join(_goal(state), key, "left").where("goal IS NULL OR d < goal").drop("goal")

    state = checkpoint(state.join(_goal(state), key, "left").where("goal IS NULL OR d <= goal"))
    tree = state.select(*key, "node", "prev")
    last = checkpoint(tree.where("node = target").withColumn("seq", F.lit(0)).select(*key, "seq", "node", "prev"))
    trail, at = last, 0
    while not last.where("prev IS NOT NULL").isEmpty():
        step, more = last, None
        for _ in range(steps):
            step = step.select(*key, (F.col("seq") + 1).alias("seq"), F.col("prev").alias("node")).join(tree, [*key, "node"]).select(*key, "seq", "node", "prev")
            more = step if more is None else more.union(step)
        more, at = checkpoint(more), at + steps
        trail, last = trail.union(more), more.where(F.col("seq") == at)
    paths = trail.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("seq")).alias("seq"), "node"))), lambda x: x["node"]).alias("path"))
    found = state.groupBy(*key).agg(F.min("goal").alias("d"), F.count("*").alias("visited")).join(paths, key, "left")
    same = F.col("source") == F.col("target")
    return asked.join(found, key, "left").select(
        "query_id", *key, F.when(same, 0.0).otherwise(F.col("d")).alias("d"), F.when(same, F.array("source")).otherwise(F.col("path")).alias("path"), F.when(same, 1).otherwise(F.coalesce("visited", F.lit(0))).cast("long").alias("visited")
    )


def _goal(state: DataFrame) -> DataFrame:
    return state.where("node = target").select("source", "target", F.col("d").alias("goal"))


def _follow(graph: _Adjacency, found: dict[int, tuple[float, int]], end: int) -> list[int]:
    path = []
    while end >= 0:
        path.append(end)
        end = found[end][1]
    return [int(graph.names[p]) for p in reversed(path)]


def _place(graph: _Adjacency, node: int) -> int:
    at = int(np.searchsorted(graph.names, node))
    return at if at < len(graph.names) and graph.names[at] == node else -1


def shortest_paths(edges: DataFrame | _Adjacency, queries: DataFrame, paths: bool = True) -> DataFrame:
    """(query_id, source, target, d, path, visited) of queries(query_id, source, target); d and path are null where the
    target can't be reached. visited counts settled nodes. Without paths, path and visited may be null: large graphs then
    need no searches."""
    return guided_paths(edges, queries, None, paths)


def guided_paths(edges: DataFrame | _Adjacency, queries: DataFrame, ahead: Ahead | _Table | None, paths: bool = True) -> DataFrame:
    """Searches led by lower bounds of the rest, which must not exceed the distance; then the result is that of
    shortest_paths, with fewer nodes visited."""

    def one(ahead: Ahead | None, graph: _Adjacency, s: int, t: int) -> tuple[float | None, list[int] | None, int]:
        end = _place(graph, t)
        if s == t:
            return 0.0, [s], 1
        rest = graph.memo("ahead", lambda: ahead(graph.names))(np.arange(len(graph.names)), np.array([end])).tolist() if ahead is not None and end >= 0 else None
        found, visited = graph.search(s, target=end, ahead=rest)
        return (found[end][0], _follow(graph, found, end), visited) if end in found else (None, None, visited)

    return _pairs(edges, queries, ahead, False, one, paths)


def _aligned(names: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table's rows for the names; NaN for names that aren't known."""
    out = np.full((len(names), table.shape[1]), np.nan)
    if len(known):
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        there = known[at] == names
        out[there] = table[at[there]]
    return out


def euclidean_ahead(nodes: DataFrame, scale: float = 1.0) -> _Table:
    """Straight-line distances times scale, less a billionth so that they stay below path lengths."""

    def make(p: pd.DataFrame) -> Ahead:
        p = p.sort_values("id")
        known, table = p["id"].to_numpy(np.int64), p[["x", "y"]].to_numpy(float)

        def of(names: np.ndarray) -> Bound:
            x, y = _aligned(names, known, table).T.copy()
            return lambda v, t: np.nan_to_num(scale * (1 - 1e-9) * np.hypot(x[v] - x[t], y[v] - y[t]))

        return of

    return _Table(nodes.select("id", F.col("x").cast("double"), F.col("y").cast("double")), "id", make)


def astar_paths(edges: DataFrame | _Adjacency, nodes: DataFrame, queries: DataFrame, scale: float = 1.0, paths: bool = True) -> DataFrame:
    """shortest_paths led by straight-line distances; scale turns distances into weights (0.9998 / tile on a unit lattice)."""
    return guided_paths(edges, queries, euclidean_ahead(nodes, scale), paths)


def alt_paths(edges: DataFrame | _Adjacency, queries: DataFrame, landmarks: DataFrame, paths: bool = True) -> DataFrame:
    """shortest_paths led by landmark bounds; landmarks(node, landmark, d) as landmark_distances gives them."""
    return guided_paths(edges, queries, landmark_ahead(landmarks), paths)


def landmark_ahead(landmarks: DataFrame) -> _Table:
    """The greatest difference of distances to a landmark that both reach; 0 where there is none."""

    def make(p: pd.DataFrame) -> Ahead:
        p = p.pivot(index="node", columns="landmark", values="d")
        known, table = p.index.to_numpy(np.int64), p.to_numpy(float)

        def of(names: np.ndarray) -> Bound:
            return _Landmarks(_aligned(names, known, table))

        return of

    return _Table(landmarks, "node", make)


def bidirectional_paths(edges: DataFrame | _Adjacency, queries: DataFrame, ahead: Ahead | _Table | None = None, paths: bool = True) -> DataFrame:
    """shortest_paths from both ends: the two searches take turns until their least keys add up to the best meeting.

    With a lower bound h, both use the consistent potential (h(v, t) - h(s, v)) / 2, one with each sign."""

    def one(ahead: Ahead | None, graph: _Adjacency, s: int, t: int) -> tuple[float | None, list[int] | None, int]:
        a, b = _place(graph, s), _place(graph, t)
        if s == t:
            return 0.0, [s], 1
        if a < 0 or b < 0:
            return None, None, 0
        of, every = graph.memo("ahead", lambda: ahead(graph.names)) if ahead is not None else None, np.arange(len(graph.names))
        lean = ((of(every, np.array([b])) - of(every, np.array([a]))) / 2).tolist() if of else [0.0] * len(graph.names)
        to, w, start = graph.lists()
        shift = lean[a] - lean[b]
        best = [{a: (0.0, -1)}, {b: (0.0, -1)}]
        done: list[set[int]] = [set(), set()]
        heaps = [[(0.0, a)], [(0.0, b)]]
        top, meet = float("inf"), -1
        while heaps[0] and heaps[1]:
            # keys are d + lean(v) - lean(s) forward and d - lean(v) + lean(t) backward
            if heaps[0][0][0] + heaps[1][0][0] >= top - shift + 1e-12:
                break
            k = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            _, u = heapq.heappop(heaps[k])
            if u in done[k]:
                continue
            done[k].add(u)
            d = best[k][u][0]
            for i in range(start[u], start[u + 1]):
                v, new = to[i], d + w[i]
                if v not in best[k] or new < best[k][v][0]:
                    best[k][v] = (new, u)
                    done[k].discard(v)
                    heapq.heappush(heaps[k], (new + (lean[v] - lean[a] if k == 0 else lean[b] - lean[v]), v))
                    if v in best[1 - k] and new + best[1 - k][v][0] < top:
                        top, meet = new + best[1 - k][v][0], v
        if meet < 0:
            return None, None, len(done[0]) + len(done[1])
        return top, _follow(graph, best[0], meet) + _follow(graph, best[1], meet)[::-1][1:], len(done[0]) + len(done[1])

    return _pairs(edges, queries, ahead, True, one, paths)


def perimeter(nodes: DataFrame, n: int = 16) -> DataFrame:
    """(id, x, y): n places around the nodes' bounds, clockwise from the top left corner; n is at least 4."""
    if n < 4:
        raise ValueError("landmarks need at least 4 places")
    side = n // 4
    b = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    steps = [(i / side, 1.0) for i in range(side + 1)] + [(1.0, 1 - i / side) for i in range(1, side + 1)] + [(1 - i / side, 0.0) for i in range(1, side + 1)] + [(0.0, i / side) for i in range(1, side)]
    at = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), (F.col("x0") + u * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + v * (F.col("y1") - F.col("y0"))).alias("y")) for k, (u, v) in enumerate(steps[:n])])
    return b.where("x0 IS NOT NULL").select(F.explode(at).alias("p")).select("p.*")


def select_landmarks(nodes: DataFrame, n: int = 16) -> DataFrame:
    """(landmark): the distinct nodes nearest to the places around."""
    return nearest(perimeter(nodes, n), nodes).select(F.col("other").alias("landmark")).distinct()


def landmark_distances(edges: DataFrame, landmarks: DataFrame, bound: float | None = None) -> DataFrame:
    """(node, landmark, d) of all landmarks(landmark) in one search; symmetric edges."""
    return sssp(edges, landmarks.select(F.col("landmark").alias("source")), bound).select("node", F.col("source").alias("landmark"), "d")


def lower_bounds(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """(source, target, bound) of pairs(source, target): the greatest difference of distances to a landmark that both reach."""
    side = lambda end, d: distances.select(F.col("node").alias(end), "landmark", F.col("d").alias(d))
    return pairs.join(side("source", "ds"), "source").join(side("target", "dt"), ["target", "landmark"]).groupBy("source", "target").agg(F.max(F.abs(F.col("ds") - F.col("dt"))).alias("bound"))


def path_nodes(paths: DataFrame) -> DataFrame:
    """(query_id, seq, node) of the paths found."""
    return paths.where("path IS NOT NULL").select("query_id", F.posexplode("path").alias("seq", "node"))


def paths_from(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, target, seq, node) along prev from each of ends(source, target) of a tree by sssp; seq counts from the target.

    Walks back one node a step for all ends at once."""
    step = ends.join(tree, (ends["source"] == tree["source"]) & (ends["target"] == tree["node"])).select(ends["source"], "target", F.lit(0).alias("seq"), "node", "prev")
    out = step = checkpoint(step)
    while not (more := step.where("prev IS NOT NULL")).isEmpty():
        t = tree.select(F.col("source").alias("s2"), F.col("node").alias("n2"), F.col("prev").alias("p2"))
        step = checkpoint(more.join(t, (F.col("source") == F.col("s2")) & (F.col("prev") == F.col("n2"))).select("source", "target", (F.col("seq") + 1).alias("seq"), F.col("n2").alias("node"), F.col("p2").alias("prev")))
        out = out.union(step)
    return out.select("source", "target", "seq", "node")


def nodes_visited(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, target, visited): the nodes no further from the source than the target."""
    asked = ends.select(F.col("source").alias("from"), "target")
    goal = tree.join(asked, (F.col("source") == F.col("from")) & (F.col("node") == F.col("target"))).select("source", "target", F.col("d").alias("goal"))
    return goal.join(tree, "source").where("d <= goal").groupBy("source", "target").agg(F.count("*").alias("visited"))


def visited_counts(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """nodes_visited of ends(source, target) without the rows of a tree, where the edges fit a task."""
    ends = ends.select("source", "target").distinct()
    graph = _small(edges)
    if graph is None or not graph.plain:
        return nodes_visited(sssp(edges, ends.select("source")), ends)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.array([(_place(graph, int(s)), _place(graph, int(t))) for s, t in zip(batch["source"], batch["target"], strict=True)], np.int64).reshape(-1, 2)
            batch, at = batch[(at >= 0).all(axis=1)], at[(at >= 0).all(axis=1)]
            for some in _batches(graph, len(at)):
                dist, d, _ = graph.many(*at[some].T)
                rows = batch[some].assign(visited=(dist <= d[:, None]).sum(axis=1))
                yield rows[np.isfinite(d)]

    dealt = _dealt(ends, "source", "target")
    return dealt.mapInPandas(run, "source long, target long, visited long")


def edge_weight(ax: Column | str, ay: Column | str, bx: Column | str, by: Column | str) -> Column:
    return F.sqrt(squared(ax, ay, bx, by))
