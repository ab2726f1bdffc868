"""Best-fit decreasing packing of token sequences.

Lengths are integers up to the capacity, so what best fit does depends on how many documents have
each length, and documents of one length may change places. The packing is therefore worked out
on that histogram, which has at most as many lines as the capacity whatever the input: lengths
come longest first, a segment tree over remaining capacities gives the tightest open bin in
logarithmic time, and as many documents as both sides have are placed in one step. The result is
that of placing document after document. Documents then look up their bin by rank in their length.

Null and empty texts are the end id alone. Repeated rows are packed each on its own; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm.common import batches, partitions, written
from tarnflow.llm.encoding import KEPT, encoder

#: Tokens that a sequence holds.
CAPACITY = 4096


class CapacityTree:
    """Segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least ``length`` that a bin has, or -1."""
        i = length + self.leaves
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Steps (length, first rank, documents, first bin, offset) and the number of bins; bin ``first bin + k`` takes the document of rank ``first rank + k``."""
    tree, open_bins, steps, bins = CapacityTree(capacity), {}, [], 0

    def opened(remaining: int, first: int, n: int) -> None:
        if remaining:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit into {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = tree.tightest(length)
            if at < 0:
                at, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[at].pop()
                tree.add(at, -n)
                if not open_bins[at]:
                    del open_bins[at]
            # a bin that takes one is the tightest from then on, until the next doesn't fit into it
            fit = at // length
            full = min(n, left // fit)
            if full:
                for k in range(fit):
                    steps.append((length, rank, full, first, capacity - at + k * length))
                    rank += full
                opened(at - fit * length, first, full)
                left -= fit * full
            if full < n:
                for k in range(min(left, fit)):
                    steps.append((length, rank, 1, first + full, capacity - at + k * length))
                    rank += 1
                if left:
                    opened(at - left * length, first + full, 1)
                    full += 1
                    left = 0
                if full < n:
                    opened(at, first + full, n - full)
    lines = np.array(steps, np.int64).reshape(-1, 5)
    return lines[np.lexsort((lines[:, 1], lines[:, 0]))], bins


def pieces(docs: DataFrame, path: str, end_id: int, word_ends: bool = True, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id, piece, start, length and checksum of every document, cut only where it is longer than the capacity."""
    close = np.array([end_id], "<u4").tobytes()

    def encode(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, word_ends, kept)
        for batch in batches(given):
            names, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[], [], [], [], []]
            for begin in range(0, len(texts), 256):
                for name, ids in zip(names[begin : begin + 256], code.encode(texts[begin : begin + 256])):
                    ids += close
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (name, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length; ``parts`` is read more than once and so should be a written table.

    Ranks within a length are counted in salted groups, so that a length that a third of all rows
    have is spread over as many tasks as there are partitions.
    """
    spark = parts.sparkSession
    salts, names = partitions(spark), parts.columns
    rows = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = best_fit_decreasing(counts, capacity)
    shared = spark.sparkContext.broadcast((steps[:, 0] * 2**44 + steps[:, 1], steps))

    def place(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines = shared.value
        for batch in batches(given):
            columns = dict(zip(batch.schema.names, batch.columns))
            length, rank = columns["length"].to_numpy(), columns["rank"].to_numpy()
            line = lines[np.searchsorted(keys, length * 2**44 + rank, side="right") - 1]
            out = [columns[c] for c in names] + [pa.array(line[:, 3] + rank - line[:, 1]), pa.array(line[:, 4])]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = rows.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema)}, sequence_id bigint, offset bigint"
    return ranked.select(*parts.columns, "rank").mapInArrow(place, out)


def pack(docs: DataFrame, path: str, end_id: int, word_ends: bool = True, capacity: int = CAPACITY, kept: int = KEPT) -> DataFrame:
    """Documents to the pieces of packed sequences; a worker keeps the ids of up to about ``kept`` words."""
    return packed(written(pieces(docs, path, end_id, word_ends, capacity, kept=kept), "pieces"), capacity)
