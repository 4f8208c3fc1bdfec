"""Views over the driver's tables that stand for the engine's inputs: SQL for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SHARED = {
    # points on an integer lattice: squares and cross products are exact
    "pts": "SELECT c_custkey AS id, (c_custkey*7919)%10007 AS x, (c_custkey*104729)%10009 AS y FROM customer",
    # square obstacles and their sides
    "obst": "SELECT s_suppkey AS poly_id, (s_suppkey*6151+500)%10007 AS cx, (s_suppkey*3571+500)%10009 AS cy, 60+s_suppkey%40 AS h FROM supplier",
    "obst_edges": "SELECT poly_id, i, cx+ax*h AS ax, cy+ay*h AS ay, cx+bx*h AS bx, cy+by_*h AS by FROM obst CROSS JOIN (VALUES (0,-1,-1,1,-1),(1,1,-1,1,1),(2,1,1,-1,1),(3,-1,1,-1,-1)) AS v(i,ax,ay,bx,by_)",
    # a route of five vertices per user, small obstacles along it, and two ends
    "routes": "SELECT u.user_id AS query_id, v.i AS seq, CAST((u.user_id*37+v.i*97)%400 AS DOUBLE) AS x, CAST((u.user_id*53+v.i*61)%100 AS DOUBLE) AS y FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS v(i)",
    "fences": "SELECT s_suppkey AS poly_id, v.i, CAST((s_suppkey*37)%400+ax*3 AS DOUBLE) AS ax, CAST((s_suppkey*53)%100+ay*3 AS DOUBLE) AS ay, CAST((s_suppkey*37)%400+bx*3 AS DOUBLE) AS bx, CAST((s_suppkey*53)%100+by_*3 AS DOUBLE) AS by FROM supplier CROSS JOIN (VALUES (0,-1,-1,1,-1),(1,1,-1,1,1),(2,1,1,-1,1),(3,-1,1,-1,-1)) AS v(i,ax,ay,bx,by_)",
    "starts": "SELECT DISTINCT user_id AS query_id, CAST((user_id*41)%400 AS DOUBLE) AS x, CAST((user_id*43)%100 AS DOUBLE) AS y FROM events",
    "goals": "SELECT DISTINCT user_id AS query_id, CAST((user_id*29+150)%400 AS DOUBLE) AS x, CAST((user_id*31+50)%100 AS DOUBLE) AS y FROM events",
    # place names with a position
    "label_in": "SELECT p_name AS name, (min(p_partkey)*7919)%10007 AS x, (min(p_partkey)*104729)%10009 AS y FROM part GROUP BY p_name",
    # supplier-part graph of small diameter, both directions
    "spg1": "SELECT l_suppkey AS src, 1000000+l_partkey AS dst, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY l_suppkey, l_partkey",
    "spg": "SELECT src, dst, w FROM spg1 UNION ALL SELECT dst, src, w FROM spg1",
    "latlon": "SELECT id, 55.78D + x/1e6D AS lat, 12.51D + y/1e6D AS lon FROM pts",
    "layers_in": "SELECT p_partkey AS id, p_name AS name, p_type AS title, concat('ws:', p_name) AS full_name FROM part",
    # consecutive points as segments
    "segs": "SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM pts a JOIN pts b ON b.id = a.id + 1",
    "near": "SELECT id, other, d2, rank FROM (SELECT a.id, b.id AS other, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) AS rank FROM pts a JOIN pts b ON a.id <> b.id) q WHERE rank <= 8",
    "edges": "SELECT DISTINCT src, dst, w FROM (SELECT id AS src, other AS dst, CAST(ceil(sqrt(d2)*100) AS BIGINT) AS w FROM near UNION ALL SELECT other, id, CAST(ceil(sqrt(d2)*100) AS BIGINT) FROM near) q",
    "pairs": "SELECT a.id AS src, b.id AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.x-b.x) <= 250 AND abs(a.y-b.y) <= 250 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 62500",
    "asked": "SELECT s_suppkey AS query_id, s_suppkey AS source, (s_suppkey*7919+7)%(SELECT count(*) FROM customer) AS target FROM supplier",
}
SPARK = SHARED | {
    "positions": "SELECT event_id, user_id AS route_id, CAST(ts AS TIMESTAMP) AS ts, value AS x, CAST(get_json_object(props, '$.k') AS DOUBLE) AS y FROM events",
    "emb2": "SELECT vec_id AS id, CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings",
}
DUCK = {k: re.sub(r"(?<=[0-9])D\b", "", v) for k, v in SHARED.items()} | {
    "positions": "SELECT event_id, user_id AS route_id, ts, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events",
    "emb2": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
}
TABLES = (*BASE, "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows, without a name in the session's catalogue."""
    text = SPARK[name]
    used = [n for n in (*SPARK, *TABLES) if re.search(rf"(?:FROM|JOIN) \(?{n}\b", text) and n != name]
    frames = {n: view(spark, sf_dir, n) if n in SPARK else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used}
    for n in used:
        text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **frames)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: WITH the named views and those that they need, then body, a query or more views and a query."""
    need: list[str] = []

    def visit(n: str) -> None:
        for m in DUCK:
            if m != n and re.search(rf"(?:FROM|JOIN) \(?{m}\b", DUCK[n]):
                visit(m)
        if n not in need:
            need.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    views = ", ".join(f"{n} AS MATERIALIZED ({DUCK[n]})" for n in need)
    if not body.startswith("SELECT"):
        text = f"WITH RECURSIVE {', '.join(filter(None, [views, body]))}"
    else:
        text = f"WITH RECURSIVE {views} {body}" if views else body
    return re.sub(r"\bby\b", '"by"', text)  # the column; the keyword is in capitals
