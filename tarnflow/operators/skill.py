"""Skill of models and analyses of sweeps: relational throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scores(pairs: DataFrame, key: str) -> DataFrame:
    """NSE, percent bias and peaks of observed and modelled values (key, t, obs, mod); both sums in one pass over means by key."""
    mean = F.avg("obs").over(W.partitionBy(key))
    met = pairs.withColumn("dev", F.pow(F.col("obs") - mean, F.lit(2)))
    return met.groupBy(key).agg(
        (1 - F.sum(F.pow(F.col("obs") - F.col("mod"), F.lit(2))) / F.sum("dev")).alias("nse"),
        (100 * F.sum(F.col("mod") - F.col("obs")) / F.sum("obs")).alias("pbias"),
        F.max("obs").alias("peak_obs"), F.max("mod").alias("peak_mod"),
        F.max_by("t", F.struct("obs", (-F.col("t")).alias("e"))).alias("t_obs"), F.max_by("t", F.struct("mod", (-F.col("t")).alias("e"))).alias("t_mod"),
    )


def factorial(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of the axes' values: literals of a fixed size."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def last_per_tag(ledger: DataFrame, tag: str, order: str) -> DataFrame:
    w = W.partitionBy(tag).orderBy(F.desc(order))
    return ledger.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def effects(runs: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Marginal mean and deviation for each value of each factor, and the factor's span; one pass over the unpivoted factors."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("setting")) for f in factors])).alias("x"), value)
    means = long.groupBy("x.factor", "x.setting").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    w = W.partitionBy("factor")
    return means.withColumn("span", F.max("mean").over(w) - F.min("mean").over(w))


def dominant(parts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The mechanism of the largest total of each cell (id, imperv, dunne, horton), ties to the first, -1 where all are dry.

    Sums of doubles depend on the order of their terms, and so do ties: with ``order`` a cell's rows are
    added one after the other by these columns, however the table is split.
    """
    kinds = ("imperv", "dunne", "horton")
    if order:
        w = W.partitionBy("id").orderBy(*order)
        upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        summed = parts.select("id", *[F.sum(c).over(upto).alias(c) for c in kinds], F.lead(F.lit(True)).over(w).isNull().alias("last"))
        sums = summed.where("last").drop("last")
    else:
        sums = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in kinds])
    top = F.greatest(*kinds)
    return sums.select("id", F.when(top <= 0, -1).when(F.col("imperv") == top, 0).when(F.col("dunne") == top, 1).otherwise(2).alias("mechanism"))
