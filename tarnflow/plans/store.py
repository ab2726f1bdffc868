"""Cut lineages: intermediate tables in the folder that the cluster names, and a cache keyed by request."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_memo: dict[tuple, DataFrame] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tarnflow-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """The rows as a written table: its plan is a scan, and a lost executor costs nothing before it."""
    where = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def once(spark: SparkSession, request: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a request, built and written the first time it is asked for in an application."""
    key = (spark.sparkContext.applicationId, *request)
    if key not in _memo:
        _memo[key] = cut(build(), str(request[0]))
    return _memo[key]


def forget() -> None:
    """What has been built is built anew when it is next asked for."""
    _memo.clear()
