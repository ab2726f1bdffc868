"""What the training-data operators share: the cluster's shared folder, Arrow text access, word hashing, document order."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and tab to carriage return: the bytes that part words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_POWER = np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one is set only where it is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tarnflow-')}"
    atexit.register(_remove_tree, own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove_tree(uri: str) -> None:
    files, path = open_fs(uri)
    if files.get_file_info(path).type == pafs.FileType.Directory:
        files.delete_dir(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def new_dir(spark: SparkSession, label: str) -> str:
    """A name for a folder of its own below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    where = new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(where)
    table = spark.read.schema(df.schema).parquet(where)
    table.written_to = where
    return table


def deleted(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again, through Spark's own file system; what is no written table stays."""
    for table in tables:
        if where := getattr(table, "written_to", None):
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark, name: str, value: str) -> Iterator[None]:
    """Within, a setting of the session has this value; afterwards what it had before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def swept(spark) -> None:
    """Has Spark's cleaner remove the files of shuffles that nothing refers to any more, which it finds only when both Python's and the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_once(uri: str, chunks: Iterator[bytes]) -> None:
    """A file that appears whole or not at all: a repeated or speculative task replaces it by the same bytes."""
    files, path = open_fs(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(part, path)


# ---------------------------------------------------------------- order by doc_id
def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def splits(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Values of the key that part it into about equal buckets; each is a value that occurs. At most ``buckets`` longs reach the driver."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, at, max(10_000, 20 * buckets)).alias("s")).first()["s"]
    return sorted(set(found or []))


def bucket_of(key: Column, edges: list[int]) -> Column:
    """Bucket k holds the keys from edges[k-1] to below edges[k]; nulls are in bucket 0. Two looks at about the root of the number of edges each."""
    if not edges:
        return F.lit(0)
    wide = int(len(edges) ** 0.5) + 1
    groups = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    firsts = F.from_json(F.lit(str([g[0] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    ordered = F.coalesce(key.cast("bigint"), F.lit(-(2**63)))
    below = lambda points: F.aggregate(points, F.lit(0), lambda n, x: n + F.when(x <= ordered, 1).otherwise(0))
    group = below(firsts)
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * wide + below(F.element_at(inner, group)))


# ---------------------------------------------------------------- text in Arrow
def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row begins (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    word = ~IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = word[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial over keyed bytes, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    powers = np.ones(longest, np.uint64)
    powers[1:] = _POWER
    powers = np.multiply.accumulate(powers)
    until = np.append(starts[1:], ends[-1])
    place = np.arange(starts[0], ends[-1]) - np.repeat(starts, until - starts)
    part = data[starts[0] : ends[-1]]
    terms = _BYTE_KEYS[part] * powers[np.minimum(place, longest - 1)]
    terms[IS_SPACE[part]] = 0
    return mix64(np.add.reduceat(terms, starts - starts[0]) + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)
