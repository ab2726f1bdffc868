"""Folds over a drainage forest (id, ds): every cell has one cell below it or none.

Sums and path folds double the length of what they have seen each round, so their number of joins
grows with the logarithm of the longest path. Each round is cut off as a written table, since
lineages would double as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.plans.store import cut


def _rounds(now: DataFrame) -> int:
    """After so many doublings every way that ends has ended; what still goes on leads into a loop and is left out."""
    return max(1, now.count()).bit_length() + 1


def accumulate(net: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over each cell and all above it; without cells that lead into a loop."""
    now = cut(net.select("id", F.col("ds").alias("ptr"), F.col(value).alias("acc")))
    for _ in range(_rounds(now)):
        live = now.where("ptr is not null")
        if live.isEmpty():
            break
        add = live.groupBy(F.col("ptr").alias("id")).agg(F.sum("acc").alias("more"))
        jump = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        now = cut(now.join(add, "id", "left").join(jump, "ptr", "left").select("id", F.col("next").alias("ptr"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    return now.where("ptr is null").select("id", F.col("acc").alias(out))


def descend(net: DataFrame, stop: str | None = None) -> DataFrame:
    """id, root, hops and length of the way down to the last cell, or to the first where ``stop`` is true (the cell itself if it is).

    With ``stop``, ``root`` is null where no such cell lies below. Cells that lead into a loop are left out.
    """
    ends = F.col(stop) if stop else F.lit(False)
    here = net.select("id", F.when(~ends, F.col("ds")).alias("ptr"), F.when(ends | F.col("ds").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("hops"), F.when(ends | F.col("ds").isNull(), F.lit(0.0)).otherwise(F.col("dist")).alias("length"))
    now = cut(here.withColumn("at", F.coalesce("ptr", "id")))
    for _ in range(_rounds(now)):
        if now.where("ptr is not null").isEmpty():
            break
        jump = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("at").alias("a2"), F.col("hops").alias("h2"), F.col("length").alias("l2"))
        now = cut(now.join(jump, "ptr", "left").select("id", F.col("p2").alias("ptr"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), (F.col("length") + F.coalesce("l2", F.lit(0.0))).alias("length"), F.coalesce("a2", "at").alias("at")))
    now = now.where("ptr is null")
    if not stop:
        return now.select("id", F.col("at").alias("root"), "hops", "length")
    marked = net.where(stop).select(F.col("id").alias("at"), F.lit(True).alias("ok"))
    return now.join(marked, "at", "left").select("id", F.when(F.col("ok"), F.col("at")).alias("root"), "hops", "length")


def path_max(net: DataFrame, value: str, rise: float, out: str) -> DataFrame:
    """max over the cells k on the way down of value(k) + rise x distance from the cell to k: outlet-to-top least gradients."""
    now = cut(net.select("id", F.col("ds").alias("ptr"), F.coalesce("dist", F.lit(0.0)).alias("d"), F.col(value).alias("m")))
    for _ in range(_rounds(now)):
        if now.where("ptr is not null").isEmpty():
            break
        jump = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("d").alias("d2"), F.col("m").alias("m2"))
        now = cut(now.join(jump, "ptr", "left").select("id", F.col("p2").alias("ptr"), (F.col("d") + F.coalesce("d2", F.lit(0.0))).alias("d"), F.greatest("m", F.col("m2") + rise * F.col("d")).alias("m")))
    return now.where("ptr is null").select("id", F.col("m").alias(out))


def upstream_min(net: DataFrame, value: str, fall: float, out: str) -> DataFrame:
    """min over a cell and the cells k above it of value(k) - fall x distance from k down to the cell: beds that never rise downstream."""
    now = cut(net.select("id", F.col("ds").alias("ptr"), F.coalesce("dist", F.lit(0.0)).alias("d"), F.col(value).alias("m")))
    for _ in range(_rounds(now)):
        live = now.where("ptr is not null")
        if live.isEmpty():
            break
        low = live.groupBy(F.col("ptr").alias("id")).agg(F.min(F.col("m") - fall * F.col("d")).alias("low"))
        jump = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("d").alias("d2"))
        now = cut(now.join(low, "id", "left").join(jump, "ptr", "left").select("id", F.col("p2").alias("ptr"), (F.col("d") + F.coalesce("d2", F.lit(0.0))).alias("d"), F.least("m", "low").alias("m")))
    return now.where("ptr is null").select("id", F.col("m").alias(out))


def kth_below(net: DataFrame, k: int) -> DataFrame:
    """id, far and length of the k-th cell below, or the last one, by binary lifting."""
    now = net.select("id", F.col("id").alias("far"), F.lit(0.0).alias("length"))
    step = cut(net.select("id", F.coalesce("ds", "id").alias("to"), F.when(F.col("ds").isNull(), F.lit(0.0)).otherwise(F.col("dist")).alias("len")))
    while k:
        if k & 1:
            now = cut(now.join(step.select(F.col("id").alias("far"), "to", "len"), "far").select("id", F.col("to").alias("far"), (F.col("length") + F.col("len")).alias("length")))
        k >>= 1
        if k:
            again = step.select(F.col("id").alias("to"), F.col("to").alias("t2"), F.col("len").alias("l2"))
            step = cut(step.join(again, "to").select("id", F.col("t2").alias("to"), (F.col("len") + F.col("l2")).alias("len")))
    return now


def strahler(net: DataFrame) -> DataFrame:
    """Stream order: that of the largest cell above, one more where two or more of them are largest.

    A cell is of more than order k where two cells of order k or more flow into it or into a cell above
    it. So each order takes one count of donors and one accumulation over the cells of the order
    before, whose number falls about fourfold. Cells that lead into a loop are left out.
    """
    now, found, k = cut(descend(net).select("id").join(net.select("id", "ds"), "id")), [], 1
    while True:
        joints = now.where("ds is not null").groupBy(F.col("ds").alias("id")).agg((F.count(F.lit(1)) > 1).alias("joint"))
        marked = cut(now.join(joints, "id", "left").select("id", "ds", F.when(F.col("joint"), 1).otherwise(0).alias("joint")))
        if marked.where("joint = 1").isEmpty():
            break
        above = cut(accumulate(marked, "joint", "joints").join(now, "id"))
        found.append(above.where("joints = 0").select("id", F.lit(k).alias("order")))
        now, k = above.where("joints > 0").select("id", "ds"), k + 1
    last = now.select("id", F.lit(k).alias("order"))
    return reduce(DataFrame.unionAll, found, last)


def reaches(net: DataFrame, longest: float) -> DataFrame:
    """id, link (its lowest cell), reach number within the link and the link's length: links end at confluences, and are cut into equal pieces of at most ``longest``."""
    donors = net.where("ds is not null").groupBy(F.col("ds").alias("id")).agg(F.count(F.lit(1)).alias("donors"))
    below = donors.select(F.col("id").alias("ds"), F.col("donors").alias("below"))
    # a link's lowest cell flows into a confluence or out
    ends = net.select("id", "ds", "dist").join(below, "ds", "left").withColumn("end", F.col("ds").isNull() | (F.col("below") > 1))
    way = descend(ends, "end").select("id", F.col("root").alias("link"), "length")
    own = way.join(ends.select(F.col("id").alias("link"), F.coalesce("dist", F.lit(0.0)).alias("last")), "link")
    sizes = own.groupBy("link").agg((F.max("length") + F.first("last")).alias("link_length"))
    pieces = F.greatest(F.ceil(F.col("link_length") / longest), F.lit(1))
    joined = own.join(sizes, "link")
    number = F.least(F.floor((F.col("length") + F.col("last")) / F.greatest(F.col("link_length"), F.lit(1e-9)) * pieces), pieces - 1)
    return joined.select("id", "link", number.cast("bigint").alias("reach"), "link_length")
