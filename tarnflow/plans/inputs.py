"""The model's inputs taken from the star-schema tables, and the SQL that derives the same for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import kernels, rain, tree
from tarnflow.plans.store import once

SIZE, BUCKET = 30.0, 21_600


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def side(spark: SparkSession, sf: str) -> int:
    return int(table(spark, sf, "orders").count() ** 0.5)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """A convergent valley with a data-dependent roughness: id, r, c, z, and centre x, y."""
    n = side(spark, sf)
    k = F.col("o_orderkey")
    r, c = F.floor(k / n).cast("bigint"), k % n
    z = (n - 1 - r) + 2 * F.abs(c - (n - 1) / 2) + 10 + 0.4 * (F.col("o_totalprice") - F.floor("o_totalprice"))
    return table(spark, sf, "orders").where(k < n * n).select(k.alias("id"), r.alias("r"), c.alias("c"), z.alias("z"), ((c + 0.5) * SIZE).alias("x"), ((r + 0.5) * SIZE).alias("y"))


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with flow direction; built once."""

    def build() -> DataFrame:
        grid = cells(spark, sf)
        return grid.join(kernels.d8(grid, side(spark, sf), SIZE), "id")

    return once(spark, ("d8", sf), build)


def net(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with flow direction, accumulation and the number of steps to the outlet; built once."""

    def build() -> DataFrame:
        ways = flow(spark, sf)
        facc = tree.accumulate(ways.withColumn("one", F.lit(1)), "one", "facc")
        return ways.join(facc, "id").join(tree.descend(ways), "id")

    return once(spark, ("net", sf), build)


def gauges(spark: SparkSession, sf: str) -> DataFrame:
    n, k = side(spark, sf), F.col("s_suppkey")
    return table(spark, sf, "supplier").where(k < 10).select(k.alias("gauge_id"), ((k * 53 % n + 0.5) * SIZE).alias("x"), ((k * 37 % n + 0.5) * SIZE).alias("y"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Depths of ten gauges in six-hour buckets."""
    t = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200)) / BUCKET) * BUCKET
    return table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("gauge_id"), t.cast("double").alias("time_s")).agg((F.sum("value") / 100).alias("depth_mm"))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return rain.rates(series(spark, sf))


# ---------------------------------------------------------------- the same in SQL
CELLS = f"""
n0 AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM orders),
cells AS (SELECT o_orderkey AS id, o_orderkey // n AS r, o_orderkey % n AS c, n,
    (n - 1 - o_orderkey // n) + 2 * abs(o_orderkey % n - (n - 1) / 2.0) + 10 + 0.4 * (o_totalprice - floor(o_totalprice)) AS z,
    (o_orderkey % n + 0.5) * {SIZE} AS x, (o_orderkey // n + 0.5) * {SIZE} AS y
    FROM orders, n0 WHERE o_orderkey < n * n)"""
D8 = "d8(code, dr, dc) AS (VALUES (64,-1,0),(128,-1,1),(1,0,1),(2,1,1),(4,1,0),(8,1,-1),(16,0,-1),(32,-1,-1))"
NET = f"""{CELLS}, {D8},
ways AS (SELECT id, z, code, (r + dr) * n + c + dc AS nid, {SIZE} * CASE WHEN code IN (2, 8, 32, 128) THEN sqrt(2.0) ELSE 1 END AS dist
    FROM cells, d8 WHERE r + dr BETWEEN 0 AND n - 1 AND c + dc BETWEEN 0 AND n - 1),
best AS (SELECT w.id, w.code, w.nid AS ds, w.dist FROM ways w JOIN cells b ON b.id = w.nid WHERE w.z > b.z
    QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY (w.z - b.z) / w.dist DESC, w.code) = 1),
flow AS (SELECT cells.*, best.code, best.ds, best.dist FROM cells LEFT JOIN best USING (id))"""
#: ``RECURSIVE`` parts: pairs (src, cur) of every cell and every cell on its way down, with steps and length.
DOWN = f"""{NET},
down AS (SELECT id AS src, id AS cur, 0 AS hops, CAST(0 AS DOUBLE) AS length FROM flow
    UNION ALL SELECT d.src, f.ds, d.hops + 1, d.length + f.dist FROM down d JOIN flow f ON f.id = d.cur WHERE f.ds IS NOT NULL)"""
FACC = f"{DOWN}, facc AS (SELECT cur AS id, count(*) AS facc FROM down GROUP BY cur), net AS (SELECT flow.*, facc FROM flow JOIN facc USING (id))"
RAIN = f"""
series AS (SELECT user_id % 10 AS gauge_id, CAST(floor((epoch(ts) - 1704067200) / {BUCKET}) * {BUCKET} AS DOUBLE) AS time_s, sum(value) / 100 AS depth_mm FROM events GROUP BY ALL),
rates AS (SELECT gauge_id, time_s, greatest(depth_mm / 1000 / coalesce(lead(time_s) OVER w - time_s, time_s - lag(time_s) OVER w), 0) AS rate FROM series WINDOW w AS (PARTITION BY gauge_id ORDER BY time_s))"""
GAUGES = f"gauges AS (SELECT s_suppkey AS gauge_id, (s_suppkey * 53 % n + 0.5) * {SIZE} AS x, (s_suppkey * 37 % n + 0.5) * {SIZE} AS y FROM supplier, n0 WHERE s_suppkey < 10)"
NEAR = "near AS (SELECT cells.id, arg_min(gauge_id, (cells.x - g.x) ** 2 + (cells.y - g.y) ** 2 + gauge_id * 1e-9) AS gauge_id FROM cells, gauges g GROUP BY cells.id)"
LAND = "land(class_code, class_name, root_zone_depth_m, mannings_n, impervious_fraction) AS (VALUES (10,'Tree cover',2.0,0.15,0.0),(20,'Shrubland',1.5,0.10,0.0),(30,'Grassland',0.8,0.04,0.0),(40,'Cropland',1.0,0.06,0.0),(50,'Built-up',0.3,0.015,0.85),(60,'Bare / sparse vegetation',0.3,0.03,0.0),(70,'Snow and ice',0.1,0.05,0.0),(80,'Permanent water bodies',0.1,0.03,0.0),(90,'Herbaceous wetland',0.5,0.05,0.0),(95,'Mangroves',0.8,0.07,0.0),(100,'Moss and lichen',0.3,0.04,0.0))"
