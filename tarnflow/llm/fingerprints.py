"""Context-triggered piecewise hashing of documents.

A rolling hash over a window of bytes ends a piece wherever its remainder by the block size is
the largest; each piece gives one letter of the signature. A fingerprint holds the signatures
of a block size and of its double, so that texts of unlike length still meet at a common one.
Two fingerprints are compared by edit distance where their block sizes are compatible.

Empty and null texts have the fingerprint ``3::``; it equals itself (likeness 1) and is unlike
anything else (0). Rows that repeat a doc_id are neighbours of one another, in the order of
their texts. Every row gives one row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import batches, bucket_of, partitions, splits

#: Documents that make a range of their own worth a task.
RANGE = 2000
#: Bytes in the rolling window, smallest block size, most letters of a signature.
WINDOW, SMALLEST, LETTERS = 7, 3, 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTORS = (np.uint32(0x01000193) ** np.arange(WINDOW, dtype=np.uint32)).astype(np.uint32)
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the window that ends at each byte; before the first byte lie zeros."""
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)])
    h = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        h += wide[WINDOW - 1 - k : len(wide) - k] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def signature(text: bytes, h: np.ndarray, block: int) -> str:
    ends = (np.flatnonzero(h % np.uint32(block) == block - 1) + 1).tolist()
    if len(ends) > LETTERS - 1:
        ends = ends[: LETTERS - 1]
    letters, begin = [], 0
    for end in ends:
        letters.append(ALPHABET[xxhash.xxh32_intdigest(text[begin:end]) & 63])
        begin = end
    if begin < len(text):
        letters.append(ALPHABET[xxhash.xxh32_intdigest(text[begin:]) & 63])
    return "".join(letters)


def fingerprint(text: bytes) -> str:
    """``block:signature:signature at twice the block``; a function of the text alone."""
    if not text:
        return f"{SMALLEST}::"
    block = SMALLEST
    while block * LETTERS < len(text):
        block *= 2
    h = rolling(np.frombuffer(text, np.uint8))
    first = signature(text, h, block)
    while block > SMALLEST and len(first) < LETTERS // 2:
        block //= 2
        first = signature(text, h, block)
    return f"{block}:{first}:{signature(text, h, 2 * block)}"


def edits(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for x in b:
        eq = where.get(x, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(across | up))
        minus = up & across
        distance += bool(plus & top) - bool(minus & top)
        plus = plus << 1 | 1
        up = (minus << 1 | (full & ~(across | plus))) & full
        down = plus & across & full
    return distance


def shares_run(a: str, b: str) -> bool:
    """Whether both hold a run of letters long enough not to be chance: seven, or a third of the shorter and at least three."""
    run = max(3, min(7, min(len(a), len(b)) // 3))
    if min(len(a), len(b)) < run:
        return False
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    return any(b[i : i + run] in runs for i in range(len(b) - run + 1))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best over common block sizes of one less edit distance by length; 0 where no block size or no run of letters is common."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    pairs = [(a1, b1), (a2, b2)] if m == n else [(a1, b2)] if m == 2 * n else [(a2, b1)] if n == 2 * m else []
    best = 0.0
    for x, y in pairs:
        if x and y and (x == y or shares_run(x, y)):
            best = max(best, 1 - edits(x, y) / max(len(x), len(y)))
    return best


def edited(text: str, following: str) -> str:
    """The text whose last quarter (rounded down) is replaced by as many first code points of the following one, or all of them."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _walk(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then in order; a bucket's last row is the first of the next one and only gives its text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None
    for batch in batches(rows):
        out = [[] for _ in names]
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for bucket, ahead, doc_id, text in zip(*columns):
            mark = fingerprint(text.encode()) if last is None or text != last[2] else last[3]
            if last is not None and last[0] == bucket:
                changed = edited(last[2], text)
                raw = changed.encode()
                other = fingerprint(raw)
                for column, value in zip(out, (last[1], len(last[2]), hashlib.sha256(raw).hexdigest(), last[3], other, likeness(last[3], other), likeness(last[3], mark))):
                    column.append(value)
            last = None if ahead else (bucket, doc_id, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness, next to that of the following document.

    Documents are dealt into ranges of doc_id whose edges are ids that occur; the first document of
    each range is also sent to the range before it, so that every task knows the one that follows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    first = found["m"]
    if first is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    edges = splits(rows, "doc_id", min(partitions(docs.sparkSession), -(-found["n"] // RANGE)))
    edges = [e for e in edges if e > first]
    bucket = bucket_of(F.col("doc_id"), edges)
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    begins = F.from_json(F.lit(str([first, *edges])), "array<bigint>")
    # an edge id's smallest row closes the bucket before; the smallest of all closes the last
    heads = (
        rows.where(F.array_contains(begins, place))
        .groupBy(F.when(place == first, F.lit(len(edges))).otherwise(bucket - 1).alias("bucket"))
        .agg(F.min(F.struct("text", "doc_id")).alias("h"))
        .select("bucket", F.lit(True).alias("ahead"), "h.doc_id", "h.text")
    )
    dealt = rows.select(bucket.alias("bucket"), F.lit(False).alias("ahead"), "doc_id", "text")
    return (
        dealt.unionByName(heads)
        .repartitionById(len(edges) + 1, F.col("bucket").cast("int"))
        .sortWithinPartitions("bucket", "ahead", "doc_id", "text")
        .mapInArrow(_walk, SCHEMA)
    )
