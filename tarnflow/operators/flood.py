"""Flood maps: heights above drains, rating curves, stages, depths; pools and transfers between grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.operators import tree
from tarnflow.plans.store import cut


def nearest_drain(net: DataFrame) -> DataFrame:
    """id and the first river cell on the way down, itself if it is one; null where there is none."""
    return tree.descend(net, "river").select("id", F.col("root").alias("drain"))


def above_drain(net: DataFrame) -> DataFrame:
    """id, drain and hand: height above the drain, null without."""
    beds = net.select(F.col("id").alias("drain"), F.col("z").alias("bed"))
    return nearest_drain(net).join(net.select("id", "z"), "id").join(beds, "drain", "left").select("id", "drain", (F.col("z") - F.col("bed")).alias("hand"))


def river_beds(net: DataFrame, fall: float = 0.0) -> DataFrame:
    """Running least bed down the rivers."""
    rivers = net.where("river")
    there = rivers.select(F.col("id").alias("ds"), F.lit(True).alias("ok"))
    only = rivers.join(there, "ds", "left").select("id", F.when(F.col("ok"), F.col("ds")).alias("ds"), "dist", "z")
    return tree.upstream_min(only, "z", fall, "bed")


def accumulate_within(net: DataFrame, mask: str, value: str, out: str) -> DataFrame:
    """Sums over the cells above that are reached inside the mask only; cells outside it have none."""
    inside = net.where(mask)
    there = inside.select(F.col("id").alias("ds"), F.lit(True).alias("ok"))
    return tree.accumulate(inside.join(there, "ds", "left").select("id", F.when(F.col("ok"), F.col("ds")).alias("ds"), value), value, out)


def levels(spark, low: float, most: float) -> DataFrame:
    """Accumulation thresholds: ``low`` and its tenfold multiples below half of the largest."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda k: F.lit(float(low)) * F.pow(F.lit(10.0), k))
    return spark.range(1).select(F.explode(F.filter(powers, lambda x: (x <= low) | (x < most / 2))).alias("level"))


def stages(spark) -> DataFrame:
    """0 to 10 m by 0.05 up to 1 m, then by 0.2 (a fixed grid, made of integers)."""
    fine = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: k / 20.0)
    coarse = F.transform(F.sequence(F.lit(6), F.lit(50)), lambda k: k / 5.0)
    return spark.range(1).select(F.posexplode(F.concat(fine, coarse)).alias("k", "y"))


def plain_area(cells: DataFrame, cell_area: float, size: float) -> DataFrame:
    """Plan area of each cell (id, reach, hand, drain, width, dist) left for the floodplain.

    River cells lose the channel's footprint; what a channel is wider than the cell is taken from
    its reach's lowest cells, by a running sum in order of height.
    """
    own = F.when(F.col("drain"), F.lit(cell_area) - F.least(F.col("width") * F.col("dist"), F.lit(cell_area))).otherwise(F.lit(cell_area))
    extra = F.sum(F.when(F.col("drain"), F.greatest((F.col("width") - size) * F.col("dist"), F.lit(0.0)))).over(W.partitionBy("reach"))
    w = W.partitionBy("reach").orderBy(F.asc_nulls_last("hand"), "id").rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.when(~F.col("drain"), F.lit(cell_area))).over(w), F.lit(0.0))
    left = F.greatest(F.coalesce(extra, F.lit(0.0)) - taken, F.lit(0.0))
    return cells.withColumns({"own": own, "left": left}).select("id", "reach", F.when(F.col("drain") | F.col("reach").isNull(), F.col("own")).otherwise(F.col("own") - F.least("left", "own")).alias("area"))


def rating(cells: DataFrame, reach: DataFrame, ys: DataFrame, cell_area: float, plain_n: float) -> DataFrame:
    """Flow and flooded area of each reach at each stage.

    Each cell (reach, hand, area) gives its part at the stages above it from the fixed grid of these;
    parts are summed by reach and stage before they are exchanged, so that few rows are.
    """
    few = F.broadcast(ys)  # a fixed grid of stages
    wet = cells.where("hand is not null").withColumn("h", F.greatest("hand", F.lit(0.0))).join(few, F.col("h") < F.col("y"))
    met = wet.groupBy("reach", "k").agg(F.sum(F.col("area") * F.pow(F.col("y") - F.col("h"), F.lit(5 / 3)) / plain_n).alias("f"), (F.count(F.lit(1)) * cell_area).alias("flooded"))
    full = reach.join(few).join(met, ["reach", "k"], "left")
    h = F.col("bank") + F.col("y")
    area = F.col("width") * h
    slot = area * F.pow(area / F.greatest(F.col("width") + 2 * F.least(h, F.col("bank")), F.lit(1e-12)), F.lit(2 / 3)) / F.col("n")
    return full.select("reach", "k", "y", (F.sqrt("slope") * (slot + F.coalesce("f", F.lit(0.0)) / F.greatest("length", F.lit(1e-9)))).alias("q"), F.coalesce("flooded", F.lit(0.0)).alias("flooded"))


def stage_of(flows: DataFrame, curves: DataFrame) -> DataFrame:
    """Stage of each flow (reach, t, q) by linear interpolation of its curve (reach, y, q), and whether it was clipped. Curves are short arrays, one a reach."""
    lines = curves.groupBy("reach").agg(F.array_sort(F.collect_list(F.struct("q", "y"))).alias("curve"))
    met = flows.join(lines, "reach")
    last = F.element_at("curve", -1)
    k = F.aggregate("curve", F.lit(0), lambda n, p: n + F.when(p["q"] <= F.col("q"), 1).otherwise(0))
    met = met.withColumn("k", k)
    a, b = F.element_at("curve", F.greatest(F.col("k"), F.lit(1))), F.element_at("curve", F.least(F.col("k") + 1, F.size("curve")))
    y = a["y"] + (F.col("q") - a["q"]) * (b["y"] - a["y"]) / (b["q"] - a["q"])
    return met.select("reach", "t", F.when(F.col("q") >= last["q"], last["y"]).when(F.col("k") == 0, F.element_at("curve", 1)["y"]).otherwise(y).alias("y"), (F.col("q") > last["q"]).alias("clipped"))


def depths(cells: DataFrame, stages_: DataFrame) -> DataFrame:
    """Greatest depth of each cell over levels (level, reach, y) and the level it comes from, ties to the first."""
    met = cells.join(stages_, "reach").withColumn("depth", F.greatest(F.col("y") - F.col("hand"), F.lit(0.0)))
    best = met.groupBy("id").agg(F.max(F.struct("depth", (-F.col("level")).alias("k"))).alias("m"))
    return best.select("id", F.col("m.depth").alias("depth"), (-F.col("m.k")).alias("level"))


def matched(fine: DataFrame, coarse: DataFrame, tile: int, radius: float, ratio: float = 1.5) -> DataFrame:
    """For each fine cell (id, x, y, a) the coarse one within the radius whose area is closest in logarithms, at most ``ratio`` apart; an equi-join on tiles."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = coarse.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("a").alias("oa"), around.alias("k"))
    other = other.withColumns({"tx": F.floor(F.col("ox") / tile) + F.col("k.i"), "ty": F.floor(F.col("oy") / tile) + F.col("k.j")})
    met = fine.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)}).join(other, ["tx", "ty"])
    near = met.where((F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2)) <= radius**2) & (F.abs(F.ln(F.col("a") / F.col("oa"))) <= F.ln(F.lit(ratio))))
    best = near.groupBy("id").agg(F.min(F.struct(F.abs(F.ln(F.col("a") / F.col("oa"))).alias("gap"), "other")).alias("m"))
    return fine.select("id").join(best, "id", "left").select("id", F.col("m.other").alias("other"))


def joined_up(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0 to n - 1 over links a-b.

    Each round every point with links goes to its smallest neighbour, which leaves no cycles but pairs,
    and what has met is one point: points with links halve at least.
    """
    label = np.arange(n)
    while len(a):
        to = np.full(n, n)
        np.minimum.at(to, a, b)
        np.minimum.at(to, b, a)
        own = np.arange(n)
        to = np.where(to == n, own, to)
        to = np.where((to[to] == own) & (own < to), own, to)
        while (to[to] != to).any():
            to = to[to]
        label, a, b = to[label], to[a], to[b]
        a, b = a[a != b], b[a != b]
    least = np.full(n, n)
    np.minimum.at(least, label, np.arange(n))
    return least[label]


def stars(links: DataFrame) -> DataFrame:
    """id and pool (the smallest id reachable) of every id in links (a, b): large and small stars in turn, in a number of rounds that grows with the logarithm of a pool's size."""
    now, before = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = cut(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("pool")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("pool")).distinct())
        before = mark


def pools(cells: DataFrame, tile: int = 256) -> DataFrame:
    """pool (its smallest id) and number of cells (id, r, c) of each group of cells that touch at sides or corners.

    Tiles are joined up on their own; only links between cells on the rims of neighbours are exchanged,
    and what meets across rims is found on the tiles' groups, not on cells.
    """
    keyed = cells.select("id", "r", "c", F.floor(F.col("r") / tile).cast("bigint").alias("tr"), F.floor(F.col("c") / tile).cast("bigint").alias("tc"))

    def join_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r, c = (rows["r"] - key[0] * tile).to_numpy(), (rows["c"] - key[1] * tile).to_numpy()
        spot = np.full((tile + 1, tile + 2), -1)  # nothing around: to the left is the last column
        ids = rows["id"].to_numpy()
        order = np.lexsort((-ids, r * tile + c))
        spot[r[order], c[order]] = order
        one = spot[r, c]
        # each row with the one that stands for its cell, and with the cells ahead of it
        a, b = np.tile(np.arange(len(ids)), 5), np.concatenate([one, *(spot[r + i, c + j] for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))])
        met = joined_up(len(ids), a[(b >= 0) & (a != b)], b[(b >= 0) & (a != b)])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, met, ids)
        rim = (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)
        return pd.DataFrame({"id": ids, "r": rows["r"], "c": rows["c"], "part": least[met], "rim": rim})

    parts = cut(keyed.groupBy("tr", "tc").applyInPandas(join_up, "id bigint, r bigint, c bigint, part bigint, rim boolean"))
    rims = parts.where("rim").select("r", "c", "part")
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("k")
    aimed = rims.select("r", "c", F.col("part").alias("a"), ahead).select((F.col("r") + F.col("k.i")).alias("r"), (F.col("c") + F.col("k.j")).alias("c"), "a")
    links = aimed.join(rims.select("r", "c", F.col("part").alias("b")), ["r", "c"]).select("a", "b")
    sizes = parts.groupBy(F.col("part").alias("id")).agg(F.count(F.lit(1)).alias("cells"))
    return sizes.join(stars(links), "id", "left").groupBy(F.coalesce("pool", "id").alias("pool")).agg(F.sum("cells").alias("cells"))
