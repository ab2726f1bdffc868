"""Readers with fixed schemas: gauges and their series, hydrographs, manifests, storm text, point forecasts, lookup tables, lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAUGES = "gauge_id STRING, name STRING, easting_m DOUBLE, northing_m DOUBLE"
#: Land cover and local climate zones: code, name, root zone in m, Manning's n, impervious share.
LAND_COVER = (
    (10, "Tree cover", 2.0, 0.15, 0.0), (20, "Shrubland", 1.5, 0.10, 0.0), (30, "Grassland", 0.8, 0.04, 0.0), (40, "Cropland", 1.0, 0.06, 0.0), (50, "Built-up", 0.3, 0.015, 0.85), (60, "Bare / sparse vegetation", 0.3, 0.03, 0.0),
    (70, "Snow and ice", 0.1, 0.05, 0.0), (80, "Permanent water bodies", 0.1, 0.03, 0.0), (90, "Herbaceous wetland", 0.5, 0.05, 0.0), (95, "Mangroves", 0.8, 0.07, 0.0), (100, "Moss and lichen", 0.3, 0.04, 0.0),
)
CLIMATE_ZONES = (
    (1, "Compact high-rise", 0.10, 0.013, 0.95), (2, "Compact mid-rise", 0.10, 0.013, 0.90), (3, "Compact low-rise", 0.20, 0.016, 0.85), (4, "Open high-rise", 0.30, 0.020, 0.65), (5, "Open mid-rise", 0.30, 0.020, 0.60), (6, "Open low-rise", 0.60, 0.030, 0.50),
    (7, "Lightweight low-rise", 0.10, 0.018, 0.75), (8, "Large low-rise", 0.20, 0.013, 0.90), (9, "Sparsely built", 0.80, 0.040, 0.20), (10, "Heavy industry", 0.20, 0.016, 0.65), (11, "Dense trees (A)", 2.00, 0.150, 0.0), (12, "Scattered trees (B)", 1.50, 0.120, 0.0),
    (13, "Bush / scrub (C)", 1.00, 0.100, 0.0), (14, "Low plants (D)", 0.80, 0.040, 0.0), (15, "Bare rock / paved (E)", 0.30, 0.015, 0.90), (16, "Bare soil (F)", 0.30, 0.030, 0.0), (17, "Water (G)", 0.10, 0.030, 0.0),
)
LOOKUP = "class_code INT, class_name STRING, root_zone_depth_m DOUBLE, mannings_n DOUBLE, impervious_fraction DOUBLE"


def lookup(spark: SparkSession, rows: tuple = LAND_COVER) -> DataFrame:
    return spark.createDataFrame(list(rows), LOOKUP)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOKUP).option("header", True).option("mode", "FAILFAST").csv(path)


def gauges(spark: SparkSession, meta: str, series: str) -> tuple[DataFrame, DataFrame]:
    """Gauges and their long series from a wide file of one column a gauge; a gauge without a column is an error."""
    table = spark.read.schema(GAUGES).option("header", True).option("mode", "FAILFAST").csv(meta)
    wide = spark.read.option("header", True).csv(series)
    columns = [c for c in wide.columns if c != "time_s"]
    missing = sorted({r["gauge_id"] for r in table.select("gauge_id").collect()} - set(columns))
    if missing or "time_s" not in wide.columns:
        raise ValueError(f"no column for {missing or ['time_s']}")
    long = wide.select([F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns]).unpivot("time_s", columns, "gauge_id", "depth_mm")
    return table, long


def hydrograph(frame: DataFrame) -> DataFrame:
    """time_s and q of any of the usual column names in any case, never below zero."""
    names = {c.lower(): c for c in frame.columns}
    time = F.col(names["time_s"]).cast("double") if "time_s" in names else F.col(names["time_hr"]).cast("double") * 3600 if "time_hr" in names else None
    flow = names.get("q_m3s") or names.get("q")
    if time is None or flow is None:
        raise ValueError("a hydrograph has time_s or time_hr, and Q_m3s or Q")
    return frame.select(time.alias("time_s"), F.greatest(F.col(flow).cast("double"), F.lit(0.0)).alias("q"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Frames (time_s, id, rate) of a table of times and Parquet paths, in any order."""
    lines = spark.read.schema("time_s DOUBLE, filepath STRING").option("header", True).csv(path).collect()
    frames = [spark.read.parquet(r["filepath"]).select(F.lit(r["time_s"]).alias("time_s"), "id", "rate") for r in lines]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def storm_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gauges and readings of storm text (a column ``value`` of lines): COORD x y "name", and GAGES year month day hour minute values."""
    v = F.col("value")
    number = r"([-+0-9.eE]+)"
    at = lines.where(v.startswith("COORD")).select(F.regexp_extract(v, rf'^COORD\s+{number}\s+{number}', 1).cast("double").alias("x"), F.regexp_extract(v, rf'^COORD\s+{number}\s+{number}', 2).cast("double").alias("y"), F.regexp_extract(v, '"([^"]*)"', 1).alias("name"))
    parts = F.split(F.trim(v), r"\s+")
    stamp = F.make_timestamp_ntz(parts[1].cast("int"), parts[2].cast("int"), parts[3].cast("int"), parts[4].cast("int"), parts[5].cast("int"), F.lit(0))
    read = lines.where(v.startswith("GAGES")).select(stamp.alias("ts"), F.posexplode(F.slice(parts, F.lit(7), F.size(parts) - 6)).alias("gauge", "text"))
    return at, read.select("ts", "gauge", F.col("text").cast("double").alias("depth_mm"))


def point_forecasts(lines: DataFrame) -> DataFrame:
    """Readings of forecast replies, one JSON object a line: depth in the interval that ends at its time, null where missing."""
    schema = "latitude DOUBLE, longitude DOUBLE, hourly STRUCT<time: ARRAY<BIGINT>, precipitation: ARRAY<DOUBLE>>"
    parsed = lines.select(F.monotonically_increasing_id().alias("request"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"))
    return parsed.select("request", F.col("j.latitude").alias("lat"), F.col("j.longitude").alias("lon"), F.inline(F.arrays_zip(F.col("j.hourly.time").alias("time"), F.col("j.hourly.precipitation").alias("depth_mm"))))


def lattice(spark: SparkSession, west: float, south: float, east: float, north: float, spacing: float, most: int) -> DataFrame:
    """Points at regular spacing that cover the bounds, the spacing widened until they are few enough."""
    while True:
        nx, ny = int(-(-(east - west) // spacing)) + 1, int(-(-(north - south) // spacing)) + 1
        if nx * ny <= most:
            break
        spacing *= 1.25
    rows = spark.range(ny).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"))
    return rows.select((F.lit(west) + F.col("i") * spacing).alias("lon"), (F.lit(south) + F.col("j") * spacing).alias("lat"))


def in_polygon(points: DataFrame, polygons: DataFrame, most: int = 10_000) -> DataFrame:
    """Points (id, x, y) with the polygon (name, xs, ys: its corners) that holds them, by the crossings of a ray; the first by name where several do, null where none.

    Polygons are few and broadcast; of more than ``most`` each is dealt to the tiles of a hundredth of the extent that its box meets, and points meet them there.
    """
    n = F.size("xs")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("xs", k).alias("x"), F.get("ys", k).alias("y"), F.get("xs", (k + 1) % n).alias("u"), F.get("ys", (k + 1) % n).alias("v")))
    shapes = polygons.withColumn("edges", edges)
    x, y = F.col("x"), F.col("y")
    crossed = F.aggregate("edges", F.lit(0), lambda c, e: c + F.when(((e["y"] > y) != (e["v"] > y)) & (x < (e["u"] - e["x"]) * (y - e["y"]) / (e["v"] - e["y"]) + e["x"]), 1).otherwise(0))
    box = [F.array_min("xs").alias("x0"), F.array_max("xs").alias("x1"), F.array_min("ys").alias("y0"), F.array_max("ys").alias("y1")]
    shapes = shapes.select("name", "edges", *box)
    inside = (x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1"))
    if polygons.count() <= most:
        met = points.join(F.broadcast(shapes), inside)
    else:
        span = shapes.agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("s")).first()["s"] / 100 or 1.0
        tile = lambda c: F.floor(F.col(c) / span)
        dealt = shapes.withColumn("tx", F.explode(F.sequence(tile("x0"), tile("x1")))).withColumn("ty", F.explode(F.sequence(tile("y0"), tile("y1"))))
        met = points.withColumns({"tx": tile("x"), "ty": tile("y")}).join(dealt, ["tx", "ty"]).where(inside)
    found = met.where(crossed % 2 == 1).groupBy("id").agg(F.min("name").alias("name"))
    return points.select("id").join(found, "id", "left")
