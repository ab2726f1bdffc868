"""Raster algebra on long tables of cells (id, r, c, z): flow directions, slopes, masks, rules, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: D8 codes with their row and column steps.
D8 = ((64, -1, 0), (128, -1, 1), (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1))
ROOT2 = 2.0**0.5


def step_length(code: Column, size: float) -> Column:
    """Length of a step: the cell size, by the root of two on diagonals."""
    return F.when(code.isin(2, 8, 32, 128), F.lit(size * ROOT2)).otherwise(F.lit(size))


def neighbours(cells: DataFrame, n: int, size: float) -> DataFrame:
    """Each cell with each neighbour inside an n by n lattice: code, nid, dist. One exploded literal, one equi-join key."""
    steps = F.array(*[F.struct(F.lit(k).alias("code"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, dr, dc in D8])
    return (
        cells.withColumn("d", F.explode(steps))
        .withColumns({"nr": F.col("r") + F.col("d.dr"), "nc": F.col("c") + F.col("d.dc")})
        .where((F.col("nr") >= 0) & (F.col("nr") < n) & (F.col("nc") >= 0) & (F.col("nc") < n))
        .withColumns({"code": F.col("d.code"), "nid": F.col("nr") * n + F.col("nc")})
        .withColumn("dist", step_length(F.col("code"), size))
        .drop("d", "nr", "nc")
    )


def downstream(codes: DataFrame, n: int, size: float = 30.0) -> DataFrame:
    """ds and dist from D8 codes (id, r, c, code); null where the step leaves the lattice or the target is not a cell."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, dr, dc in D8])
    step = F.try_element_at(F.filter(table, lambda x: x["k"] == F.col("code")), F.lit(1))
    moved = codes.withColumn("s", step).withColumns({"nr": F.col("r") + F.col("s.dr"), "nc": F.col("c") + F.col("s.dc")})
    inside = (F.col("nr") >= 0) & (F.col("nr") < n) & (F.col("nc") >= 0) & (F.col("nc") < n)
    aimed = moved.withColumn("aim", F.when(inside, F.col("nr") * n + F.col("nc")))
    there = codes.select(F.col("id").alias("aim"), F.lit(True).alias("hit"))
    return aimed.join(there, "aim", "left").select("id", F.when(F.col("hit"), F.col("aim")).alias("ds"), F.when(F.col("hit"), step_length(F.col("code"), size)).alias("dist"))


def slope(net: DataFrame, n: int, size: float = 30.0, least: float = 1e-4) -> DataFrame:
    """Slope along the flow; cells whose way leaves the mask take the gradient from the cell behind, else the least slope."""
    table = F.create_map(*[x for k, dr, dc in D8 for x in (F.lit(k), F.lit(dr * n + dc))])
    below = net.select(F.col("id").alias("ds"), F.col("z").alias("zd"))
    behind = net.select(F.col("id").alias("back"), F.col("z").alias("zb"))
    joined = net.join(below, "ds", "left").withColumn("back", F.col("id") - table[F.col("code")]).join(behind, "back", "left")
    dist = step_length(F.col("code"), size)
    return joined.select("id", F.greatest(F.coalesce((F.col("z") - F.col("zd")) / dist, (F.col("zb") - F.col("z")) / dist, F.lit(least)), F.lit(least)).alias("slope"))


def window(cells: DataFrame, top: int, left: int, rows: int, columns: int) -> DataFrame:
    """A part of a raster on its own lattice; the filter reaches the scan."""
    inside = cells.where(F.col("r").between(top, top + rows - 1) & F.col("c").between(left, left + columns - 1))
    return inside.select((F.col("r") - top).alias("r"), (F.col("c") - left).alias("c"), "z")


def align_nearest(cells: DataFrame, target: DataFrame, size: float, x0: float, y0: float) -> DataFrame:
    """Values of the nearest source cells at target points (id, x, y); null beyond the source."""
    at = target.withColumns({"c": F.floor((F.col("x") - x0) / size).cast("bigint"), "r": F.floor((y0 - F.col("y")) / size).cast("bigint")})
    return at.join(cells.select("r", "c", "z"), ["r", "c"], "left").select("id", "z")


def align_bilinear(cells: DataFrame, target: DataFrame, size: float, x0: float, y0: float) -> DataFrame:
    """Values at target points from the four cell centres around, weights over those that exist; null where none does."""
    u, v = (F.col("x") - x0) / size - 0.5, (F.lit(y0) - F.col("y")) / size - 0.5
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = target.withColumns({"u": u, "v": v}).withColumn("k", F.explode(corners))
    spread = spread.withColumns({"c": F.floor("u").cast("bigint") + F.col("k.j"), "r": F.floor("v").cast("bigint") + F.col("k.i")})
    weight = (1 - F.abs(F.col("u") - F.col("c"))) * (1 - F.abs(F.col("v") - F.col("r")))
    met = spread.withColumn("w", weight).join(cells.select("r", "c", "z"), ["r", "c"], "left")
    found = F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    return met.groupBy("id").agg((F.sum(F.col("w") * F.col("z")) / F.when(found > 0, found)).alias("z"))


def sample(target: DataFrame, raster: DataFrame, value: str) -> DataFrame:
    """A raster's values on active cells, null where it has none."""
    return target.join(raster.select("id", value), "id", "left")


def by_bins(z: Column, bins: list[tuple[float, float, float]]) -> Column:
    """Values of bins [low, high): of overlapping bins the last wins; null in none."""
    found = F.lit(None).cast("double")
    for low, high, value in bins:
        found = F.when((z >= low) & (z < high), F.lit(value)).otherwise(found)
    return found


def by_breaks(z: Column, breaks: list[tuple[float, float]]) -> Column:
    """The value of the first upper limit that isn't exceeded; null above all."""
    found = F.lit(None).cast("double")
    for high, value in reversed(breaks):
        found = F.when(z <= high, F.lit(value)).otherwise(found)
    return found


def filled_with_mean(df: DataFrame, value: str, given: float | None = None) -> DataFrame:
    """Nulls become the given value or the mean of the rest (one partial aggregate, broadcast back)."""
    if given is not None:
        return df.withColumn(value, F.coalesce(value, F.lit(given)))
    mean = F.broadcast(df.agg(F.avg(value).alias("__mean")))  # a single row
    return df.crossJoin(mean).withColumn(value, F.coalesce(value, "__mean")).drop("__mean")


def clip(cells: DataFrame, mask: DataFrame, nodata: float) -> DataFrame:
    return cells.join(mask.select("id", F.lit(True).alias("in")), "id", "left").select("id", "r", "c", F.when(F.col("in"), F.col("z")).otherwise(F.lit(nodata)).alias("z"))


def ordered(net: DataFrame) -> DataFrame:
    """Position by accumulation, then row and column. Ranks add up over ranges of the accumulation, so no task sorts all cells."""
    spark = net.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = sorted(set(net.agg(F.percentile_approx("facc", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("e")).first()["e"] or []))
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("facc") > e, 1).otherwise(0)
    dealt = net.withColumn("__b", bucket)
    sizes = {r["__b"]: r["count"] for r in dealt.groupBy("__b").count().collect()}
    before, total = {}, 0
    for b in sorted(sizes):
        before[b], total = total, total + sizes[b]
    start = F.create_map(*[x for b, k in before.items() for x in (F.lit(b), F.lit(k))]) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(W.partitionBy("__b").orderBy("facc", "r", "c"))
    return dealt.withColumn("pos", (start[F.col("__b")] + rank - 1).cast("bigint")).drop("__b")


def utm_zone(lon: Column) -> Column:
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def conditioned(net: DataFrame, how: str = "carve", rise: float = 1e-4) -> DataFrame:
    """Heights (id, z) without sinks: ``fill`` raises cells to the lowest way out of the grid, ``carve`` keeps ways and gives them a least gradient. Cells that are a ``lake`` stay as they are."""
    from tarnflow.operators import kernels, tree

    if how == "fill":
        found = kernels.fill(net.select("id", "r", "c", "z"))
    elif how == "carve":
        found = tree.path_max(net, "z", rise, "z")
    else:
        raise ValueError(f"no such way to condition a terrain: {how!r}")
    before = net.select("id", F.col("z").alias("was"), "lake")
    return before.join(found, "id", "left").select("id", F.when(F.coalesce("lake", F.lit(False)) | F.col("z").isNull(), F.col("was")).otherwise(F.col("z")).alias("z"))
