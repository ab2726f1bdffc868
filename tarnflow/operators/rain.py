"""Rain in space and time: gauges (gauge_id, x, y), series (gauge_id, time_s, depth_mm), cells (id, x, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.plans.store import cut

#: Gauges up to this many are broadcast to the cells; more are met through tiles.
FEW_GAUGES = 1_000
#: Values of gauges that are broadcast at a time.
TIMES = 1_000_000


def rates(series: DataFrame) -> DataFrame:
    """Depths in mm to rates in m/s over the gap that follows; the last repeats the gap before it, a lone row has none."""
    w = W.partitionBy("gauge_id").orderBy("time_s")
    gap = F.coalesce(F.lead("time_s").over(w) - F.col("time_s"), F.col("time_s") - F.lag("time_s").over(w))
    return series.select("gauge_id", "time_s", F.greatest(F.col("depth_mm") / 1000 / gap, F.lit(0.0)).alias("rate"))


def uniform(spark, rate_mm_h: float, duration_s: float) -> DataFrame:
    """A steady storm as one gauge of three rows."""
    r = rate_mm_h / 1000 / 3600
    return spark.createDataFrame([(0, 0.0, r), (0, duration_s - 1e-6, r), (0, duration_s, 0.0)], "gauge_id bigint, time_s double, rate double")


def _with_gauges(cells: DataFrame, gauges: DataFrame) -> DataFrame:
    """Cells, each with all gauges and their squared distances as one array ``g``: gauges are one broadcast row, whose size is checked, and cells are not exchanged."""
    if gauges.limit(FEW_GAUGES + 1).count() > FEW_GAUGES:
        raise ValueError(f"more than {FEW_GAUGES} gauges: use nearest_by_tiles")
    all_ = F.broadcast(gauges.agg(F.array_sort(F.collect_list(F.struct("gauge_id", F.col("x").alias("gx"), F.col("y").alias("gy")))).alias("all")))
    far = F.transform("all", lambda g: F.struct(((F.col("x") - g["gx"]) ** 2 + (F.col("y") - g["gy"]) ** 2).alias("d2"), g["gauge_id"].alias("gauge_id")))
    return cells.select("id", "x", "y").join(all_).select("id", far.alias("g"))


def thiessen(cells: DataFrame, gauges: DataFrame) -> DataFrame:
    """id and nearest gauge, ties to the smallest gauge; found within each row."""
    return _with_gauges(cells, gauges).select("id", F.array_min("g")["gauge_id"].alias("gauge_id"))


def nearest_by_tiles(cells: DataFrame, gauges: DataFrame, tile: float, rings: int = 1) -> DataFrame:
    """Nearest gauge within ``rings`` tiles, as an equi-join on tiles, for any number of gauges; null beyond."""
    key = lambda x, y: (F.floor(x / tile).cast("bigint").alias("tx"), F.floor(y / tile).cast("bigint").alias("ty"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)]))
    spread = gauges.select("gauge_id", F.col("x").alias("gx"), F.col("y").alias("gy"), *key(F.col("x"), F.col("y")), around.alias("k"))
    spread = spread.select("gauge_id", "gx", "gy", (F.col("tx") + F.col("k.i")).alias("tx"), (F.col("ty") + F.col("k.j")).alias("ty"))
    met = cells.select("id", "x", "y", *key(F.col("x"), F.col("y"))).join(spread, ["tx", "ty"], "left")
    return met.groupBy("id").agg(F.min(F.when(F.col("gauge_id").isNotNull(), F.struct(((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2).alias("d2"), "gauge_id"))).alias("m")).select("id", F.col("m.gauge_id").alias("gauge_id"))


def nearest_of_many(cells: DataFrame, points: DataFrame) -> DataFrame:
    """For each of a few points (gauge_id, x, y; their number is checked) the nearest of many cells, ties to the smallest id: each cell meets all points in its row, and one row a point leaves a task."""
    near = F.min(F.struct("g.d2", "id")).alias("m")
    return _with_gauges(cells, points).select("id", F.explode("g").alias("g")).groupBy("g.gauge_id").agg(near).select("gauge_id", F.col("m.id").alias("cell"))


def _weighed(cells: DataFrame, gauges: DataFrame, power: float) -> DataFrame:
    """id and array ``w`` of (gauge_id, raw) with the total of raw weights, made within each row; a gauge on the spot has all."""
    hit = F.exists("g", lambda g: g["d2"] == 0)
    raw = F.transform("g", lambda g: F.struct(g["gauge_id"].alias("gauge_id"), F.when(F.col("hit"), (g["d2"] == 0).cast("double")).otherwise(F.pow(g["d2"], F.lit(-power / 2))).alias("raw")))
    weighed = _with_gauges(cells, gauges).withColumn("hit", hit).select("id", raw.alias("w"))
    return weighed.withColumn("total", F.aggregate("w", F.lit(0.0), lambda t, x: t + x["raw"]))


def idw(cells: DataFrame, gauges: DataFrame, power: float = 2.0) -> DataFrame:
    """id, gauge and weight by inverse distance; a gauge on the spot has all. Weights are made within each row."""
    return _weighed(cells, gauges, power).select("id", F.inline("w"), "total").select("id", "gauge_id", (F.col("raw") / F.col("total")).alias("w"))


def idw_field(cells: DataFrame, gauges: DataFrame, rates_: DataFrame, power: float = 2.0) -> DataFrame:
    """``field`` of the weights of ``idw``, without an exchange of cells: each row of a cell meets all gauges' rates of a time in one row (gauge_id, t, value).

    Rows of times are broadcast, ``TIMES`` values at a time; more take more passes over the cells.
    """
    order = [r["gauge_id"] for r in gauges.select("gauge_id").sort("gauge_id").limit(FEW_GAUGES + 1).collect()]  # _with_gauges refuses more
    known = {g: k for k, g in reversed(list(enumerate(order)))}
    one = rates_.where(F.col("gauge_id").isin(list(known))).groupBy("t", "gauge_id").agg(F.sum("value").alias("value"))
    lines = one.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("gauge_id", "value"))).alias("m"))
    times = cut(lines.select("t", F.transform(F.array(*map(F.lit, order)).cast("array<bigint>"), lambda g: F.try_element_at(F.col("m"), g)).alias("v")))
    held = _weighed(cells, gauges, power).select("id", F.transform("w", lambda x: x["raw"] / F.col("total")).alias("w"))
    terms = [F.get("w", F.lit(k)) * F.get("v", F.lit(k)) for k in range(len(order))]
    some = F.exists("v", lambda v: v.isNotNull())
    passes = max(1, -(-times.count() * len(order) // TIMES))
    parts = [held.join(F.broadcast(times.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k).withColumn("some", some))) for k in range(passes)]
    rate = F.when(F.col("some"), _sum([F.coalesce(x, F.lit(0.0)) for x in terms])).alias("rate")
    return reduce(DataFrame.unionAll, [p.select("id", "t", rate) for p in parts])


def _sum(terms: list[Column]) -> Column:
    """The terms' sum as a tree of little depth."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0] if terms else F.lit(None).cast("double")


def inside(gauges: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Gauges on an active cell, or all where none is."""
    at = gauges.withColumns({"c": F.floor(F.col("x") / size).cast("bigint"), "r": F.floor(F.col("y") / size).cast("bigint")})
    held = at.join(cells.select("r", "c", F.lit(True).alias("on")), ["r", "c"], "left")
    some = F.max(F.coalesce("on", F.lit(False))).over(W.partitionBy())  # one row a gauge
    return held.withColumn("some", some).where(F.coalesce("on", F.lit(False)) | ~F.col("some")).select("gauge_id", "x", "y")


def _brackets(series: DataFrame, key: str, time: str, value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(time)
    return series.select(key, F.col(time).alias("t0"), F.col(value).alias("v0"), F.lead(time).over(w).alias("t1"), F.lead(value).over(w).alias("v1"), F.lag(time).over(w).alias("tb"), F.lag(value).over(w).alias("vb"), F.row_number().over(w).alias("k"))


def interpolate(series: DataFrame, times: DataFrame, policy: str, key: str = "gauge_id", time: str = "time_s", value: str = "rate") -> DataFrame:
    """Linear interpolation at ``times`` (key, t): zero, hold or extrapolate outside the series.

    An as-of join by union and window: shuffled once by key, no inequality join.
    """
    w = W.partitionBy(key).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    steps = _brackets(series, key, time, value)
    first = steps.where("k = 1").select(key, F.col("t0").alias("first_t"), F.col("v0").alias("first_v"), F.col("t1").alias("second_t"), F.col("v1").alias("second_v"))
    knots = steps.select(key, F.col("t0").alias("t"), F.lit(0).alias("kind"), F.struct("t0", "v0", "t1", "v1", "tb", "vb").alias("s"))
    asked = times.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast(knots.schema["s"].dataType).alias("s"))
    met = knots.unionByName(asked).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("kind = 1").join(first, key, "left")
    t, s = F.col("t"), F.col("s")
    within = s["v0"] + (s["v1"] - s["v0"]) * (t - s["t0"]) / (s["t1"] - s["t0"])
    if policy == "zero":
        before, after = F.lit(0.0), F.when(t == s["t0"], s["v0"]).otherwise(F.lit(0.0))
    elif policy == "hold":
        before, after = F.col("first_v"), s["v0"]
    else:
        ahead = F.col("first_v") + (F.col("second_v") - F.col("first_v")) * (t - F.col("first_t")) / (F.col("second_t") - F.col("first_t"))
        before = F.coalesce(ahead, F.col("first_v"))
        after = F.coalesce(s["v0"] + (s["v0"] - s["vb"]) * (t - s["t0"]) / (s["t0"] - s["tb"]), s["v0"])
    return met.select(key, "t", F.when(s.isNull(), before).when(s["t1"].isNull(), after).otherwise(within).alias("value"))


def field(weights: DataFrame, rates_: DataFrame) -> DataFrame:
    """Rate of each cell and time from its weights (id, gauge_id, w) and the gauges' rates (gauge_id, t, value)."""
    return weights.join(rates_, "gauge_id").groupBy("id", "t").agg(F.sum(F.col("w") * F.col("value")).alias("rate"))


def rain_fraction(z: Column, low: float, high: float) -> Column:
    """Share of rain, not snow: one below ``low``, none above ``high``, or a step where these meet."""
    if high <= low:
        return F.when(z <= low, 1.0).otherwise(0.0)
    return F.least(F.greatest((F.lit(high) - z) / (high - low), F.lit(0.0)), F.lit(1.0))


def regular(series: DataFrame, step: float, start: float, end: float) -> DataFrame:
    """A regular series of each gauge: gaps and what lies outside are zero, depths at least zero."""
    ids = series.select("gauge_id").distinct()
    grid = ids.select("gauge_id", F.explode(F.transform(F.sequence(F.lit(int(start)), F.lit(int(end)), F.lit(int(step))), lambda t: t.cast("double"))).alias("time_s"))
    return grid.join(series, ["gauge_id", "time_s"], "left").select("gauge_id", "time_s", F.greatest(F.coalesce("depth_mm", F.lit(0.0)), F.lit(0.0)).alias("depth_mm"))


def merged_points(points: DataFrame) -> DataFrame:
    """Served points by rounded place, first request first, without those that never report; numbered from north to south, then west to east."""
    w = W.partitionBy(F.round("lat", 3), F.round("lon", 3)).orderBy("request")
    some = points.where("depth_mm is not null").select("request").distinct()
    kept = points.select("request", "lat", "lon").distinct().join(some, "request", "left_semi").withColumn("turn", F.row_number().over(w)).where("turn = 1")
    # one row a served point: few enough for a single ordered window
    return kept.select("request", "lat", "lon", F.row_number().over(W.orderBy(F.desc("lat"), "lon")).alias("gauge_id"))
