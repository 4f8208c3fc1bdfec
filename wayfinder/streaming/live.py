"""Live positions along routes, as streams: positions(route_id, ts, x, y)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.route import split_progress
from ..session import shared_folder


def as_stream(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A Parquet table as a stream that brings what is there and ends."""
    one = spark.read.parquet(f"{path}/{table}.parquet")
    return spark.readStream.schema(one.schema).option("pathGlobFilter", f"{table}.parquet").parquet(path) if not _is_folder(spark, f"{path}/{table}.parquet") else spark.readStream.schema(one.schema).parquet(f"{path}/{table}.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its input ends: of mode complete the last batch's rows, else those of all batches.

    Rows go from the executors to Parquet in the session's shared folder, so none pass the driver."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark).rstrip('/')}/stream_{uuid.uuid4().hex}"
    written: dict[int, str] = {}

    def batch(df: DataFrame, number: int) -> None:
        written[number] = f"{place}/rows/{number}"
        df.write.mode("overwrite").parquet(written[number])

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    paths = [written[n] for n in sorted(written)]
    rows = spark.read.schema(stream.schema)
    return rows.parquet(*(paths[-1:] if mode == "complete" else paths)) if paths else spark.createDataFrame([], stream.schema)


def latest(positions: DataFrame) -> DataFrame:
    """The last position of each route, of equals that of the greatest event; over a batch, or a stream in update mode."""
    return positions.groupBy("route_id").agg(F.max_by(F.struct("ts", "x", "y"), F.struct("ts", "event_id")).alias("p")).select("route_id", "p.*")


def windows(positions: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(route_id, start, n): positions in each window; rows later than the watermark are dropped."""
    w = positions.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "route_id").agg(F.count("*").alias("n"))
    return w.select("route_id", F.col("w.start").alias("start"), "n")


def debounced(queries: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """(session_id, ts, q): the last of queries(session_id, ts, q) that follow each other within the gap."""
    s = queries.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.max_by("q", "ts").alias("q"), F.max("ts").alias("ts"))
    return s.select("session_id", "ts", "q")


def progress(spark: SparkSession, positions: DataFrame, routes: DataFrame, sink: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """A running query that hands sink the progress of each micro-batch's last positions along routes(query_id, seq, x, y)."""

    def batch(df: DataFrame, number: int) -> None:
        sink(split_progress(latest(df).select(F.col("route_id").alias("query_id"), "x", "y"), routes), number)

    return positions.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", f"{shared_folder(spark).rstrip('/')}/progress-{uuid.uuid4().hex}").start()


def reroutes(strays: DataFrame, far: float = 20.0) -> DataFrame:
    """(route_id, version, ts, x, y): an event whenever a route's position gets further than `far` from it.

    strays(route_id, ts, x, y, d), d being the distance to the route. A route's state is its version; it rises when a
    position is far and the one before was not, as the new route then starts at the position."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        version, away = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "x", "y"])
        for r in rows.itertuples():
            if r.d > far and not away:
                version += 1
                out.append((key[0], version, r.ts, r.x, r.y))
            away = int(r.d > far)
        state.update((version, away))
        yield pd.DataFrame(out, columns=["route_id", "version", "ts", "x", "y"])

    return strays.groupBy("route_id").applyInPandasWithState(step, "route_id long, version int, ts timestamp, x double, y double", "version int, away int", "append", "NoTimeout")
