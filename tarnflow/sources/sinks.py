"""Writers: hydrographs, ledgers, wide gauges, fields by time, model states, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_hydrograph(flows: DataFrame, path: str) -> None:
    flows.select("time_s", (F.col("time_s") / 3600).alias("time_hr"), F.col("q").alias("Q_m3s")).write.mode("overwrite").option("header", True).csv(path)


def append_ledger(row: DataFrame, path: str) -> None:
    """Adds rows; those of one run go together under its tag."""
    row.write.mode("append").parquet(path)


def wide_gauges(records: DataFrame, gauges: list[str], values: list[str]) -> DataFrame:
    """One row a time, one column for each gauge and value; the gauges are named, so the pivot needs no pass of its own."""
    return records.groupBy("time_s").pivot("gauge_id", gauges).agg(*[F.first(v).alias(v) for v in values])


def write_fields(fields: DataFrame, path: str) -> None:
    """Fields (time_s, id, ...) partitioned by time, so that a frame is one folder."""
    fields.write.mode("overwrite").partitionBy("time_s").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables as CSV, one folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_state(state: DataFrame, path: str, hours: float, grid: DataFrame, scheme: str, parameters: list[str]) -> None:
    """A model state (id, ...) after so many hours, in a folder of its own, and beside it what a run that goes on has to agree with: the grid's checksum, the scheme and the summaries of the parameters."""
    state.write.mode("overwrite").parquet(f"{path}/hours={hours:g}/state")
    _meta(grid, scheme, parameters).write.mode("overwrite").parquet(f"{path}/hours={hours:g}/meta")


def _meta(grid: DataFrame, scheme: str, parameters: list[str]) -> DataFrame:
    check = grid.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.xxhash64("id", "ds").cast("decimal(38,0)")).alias("checksum")).withColumn("scheme", F.lit(scheme))
    return summary(grid, parameters).join(F.broadcast(check))  # one row


def read_state(spark, path: str, hours: float, grid: DataFrame, scheme: str, parameters: list[str], tolerance: float = 1e-5) -> DataFrame:
    """The state, or a ValueError that names what is not as it was: grid, scheme, or a parameter beyond the tolerance."""
    saved, now = ({r["name"]: r.asDict() for r in m.collect()} for m in (spark.read.parquet(f"{path}/hours={hours:g}/meta"), _meta(grid, scheme, parameters)))
    if saved.keys() != now.keys():
        raise ValueError(f"a state with other parameters: {sorted(saved)}")
    for name, old in saved.items():
        for what, value in now[name].items():
            same = value == old[what] if not isinstance(value, float) or old[what] is None else abs(value - old[what]) <= tolerance * max(abs(value), abs(old[what]))
            if not same:
                raise ValueError(f"a state of another {what if what in ('cells', 'checksum', 'scheme') else name}: {old[what]} and not {value}")
    return spark.read.parquet(f"{path}/hours={hours:g}/state")


def summary(state: DataFrame, values: list[str]) -> DataFrame:
    """Checks of a parameter table: count, sums, least, greatest and missing of each column."""
    out = []
    for v in values:
        c = F.col(v)
        out.append(F.struct(F.lit(v).alias("name"), F.count(c).alias("n"), F.sum(c).alias("total"), F.sum(c * c).alias("squares"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c.isNull()).alias("missing")))
    return state.agg(F.array(*out).alias("a")).select(F.inline("a"))


def outlines(lines: DataFrame) -> DataFrame:
    """GeoJSON of lines (line, k, x, y) as text, vertices in order."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    return lines.groupBy("line").agg(F.to_json(F.struct(F.lit("LineString").alias("type"), path.alias("coordinates"))).alias("geometry"))
