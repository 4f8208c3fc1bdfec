"""Union-find over links that live in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from .common import checkpoint

#: Links that one task may search; some 100 bytes each there.
ONE_TASK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of links (a, b): (node, root) for every node, root being the least that the task's links reach."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    for k in range(0, len(nodes), 100_000):
        some = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the least node of its component. No links give no rows.

    Union-find in each task leaves a link for each of the task's nodes. If a count says that one task can hold those, it ends
    there; otherwise rounds of joins go on, in which no task holds a whole component. Loops and null ends are ignored."""
    left = checkpoint(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "node long, root long"))
    left = left.where("node <> root")
    if left.count() <= ONE_TASK:
        return checkpoint(left.coalesce(1).mapInArrow(_forest, "node long, root long"))
    e = stars(left.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
