"""Token-id files of bit planes.

Format, all integers little-endian. A file begins with the eight bytes ``PLANES01`` and holds
chunks of a fixed number of ids. A chunk is transposed into planes: plane k holds bit k of every
id, eight ids a byte (kind ``bit``), or byte k of every id (kind ``byte``); planes above the
largest id are left out. Each plane is a zstandard frame. After the chunks come two zstandard
frames, the documents (pairs of signed 64-bit id and signed 64-bit number of tokens n, or -1 - n
for a document without an id) and the index; for each chunk the index has unsigned 64-bit integers: first byte, number of ids, number of
planes, then the length of each plane's frame. The trailer is six unsigned 64-bit integers: place
and length of the documents, place and length of the index, number of ids, kind (1 bit, 8 byte);
then ``PLANES01`` again.

Files are cut at ranges of doc_id, so their names give the order of all ids; a document lies in
one file. Null and empty texts are the end id alone. Rows that repeat a doc_id follow each other
in the order of their texts. An empty table gives no file and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import batches, bucket_of, new_dir, open_fs, partitions, splits, write_once
from tarnflow.llm.encoding import encoder

MAGIC = b"PLANES01"
#: Ids in a chunk: a multiple of eight.
CHUNK = 65_536


_SWAPS = ((np.uint64(7), np.uint64(0x00AA00AA00AA00AA)), (np.uint64(14), np.uint64(0x0000CCCC0000CCCC)), (np.uint64(28), np.uint64(0x00000000F0F0F0F0)))


def turned(octets: np.ndarray) -> np.ndarray:
    """Eight by eight bits, a row in a byte, turned into columns: bit k of byte j becomes bit j of byte k, for every eight bytes. Its own inverse."""
    x = np.ascontiguousarray(octets).view("<u8")
    for shift, mask in _SWAPS:
        t = (x ^ (x >> shift)) & mask
        x = x ^ t ^ (t << shift)
    return x.view(np.uint8).reshape(-1, 8)


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of up to a chunk of ids, lowest first."""
    ids = np.ascontiguousarray(ids, "<u4")
    width = int(ids.max()).bit_length() if len(ids) else 0
    octets = ids.view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range((width + 7) // 8)]
    padded = np.zeros((-(-len(ids) // 8) * 8, 4), np.uint8)
    padded[: len(ids)] = octets
    planes = []
    for k in range((width + 7) // 8):
        planes += [p.tobytes() for p in turned(padded[:, k]).T]
    return planes[:width]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ids that ``to_planes`` took."""
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros((-(-n // 8) * 8, 4), np.uint8)
    for k in range(0, len(planes), 8):
        rows = np.zeros((len(out) // 8, 8), np.uint8)
        for i, plane in enumerate(planes[k : k + 8]):
            rows[:, i] = np.frombuffer(plane, np.uint8)
        out[:, k // 8] = turned(rows.reshape(-1)).reshape(-1)
    return out.reshape(-1).view("<u4")[:n]


def file_of(documents: Iterator[tuple[int | None, bytes]], kind: str = "bit", chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a file of documents (id, ids as bytes), a piece at a time; holds one chunk and the index."""
    pack, place, index, names, total = zstandard.ZstdCompressor(level=3), len(MAGIC), [], [], 0
    yield MAGIC
    waiting, size = [], 0

    def out(data: bytes) -> bytes:
        nonlocal place
        frames = [pack.compress(p) for p in to_planes(np.frombuffer(data, "<u4"), kind)]
        index.extend([place, len(data) // 4, len(frames), *map(len, frames)])
        place += sum(map(len, frames))
        return b"".join(frames)

    for name, data in documents:
        names += [0, -1 - len(data) // 4] if name is None else [name, len(data) // 4]
        total += len(data) // 4
        waiting.append(data)
        size += len(data)
        if size >= 4 * chunk:
            held = b"".join(waiting)
            for begin in range(0, len(held) - 4 * chunk + 1, 4 * chunk):
                yield out(held[begin : begin + 4 * chunk])
            rest = len(held) % (4 * chunk)
            waiting, size = [held[len(held) - rest :]], rest
    if size:
        yield out(b"".join(waiting))
    first = pack.compress(np.array(names, "<i8").tobytes())
    second = pack.compress(np.array(index, "<u8").tobytes())
    yield first + second + np.array([place, len(first), place + len(first), len(second), total, 1 if kind == "bit" else 8], "<u8").tobytes() + MAGIC


class TokenFile:
    """Reads a file chunk by chunk; ``ids(begin, end)`` touches only the chunks that hold them."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 56)
        tail = source.read(56)
        if tail[48:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        a, m, b, n, self.total, kind = np.frombuffer(tail[:48], "<u8").astype(int).tolist()
        self.kind = "bit" if kind == 1 else "byte"
        source.seek(a)
        self.names = np.frombuffer(zstandard.decompress(source.read(m)), "<i8").reshape(-1, 2)
        source.seek(b)
        index = np.frombuffer(zstandard.decompress(source.read(n)), "<u8").astype(int).tolist()
        self.chunks, i = [], 0
        while i < len(index):
            place, ids, planes = index[i : i + 3]
            self.chunks.append((place, ids, index[i + 3 : i + 3 + planes]))
            i += 3 + planes

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(self.chunk, range(len(self.chunks)))

    def chunk(self, k: int) -> np.ndarray:
        place, n, lengths = self.chunks[k]
        self.source.seek(place)
        data, planes, at = self.source.read(sum(lengths)), [], 0
        unpack = zstandard.ZstdDecompressor()
        for length in lengths:
            planes.append(unpack.decompress(data[at : at + length]))
            at += length
        return from_planes(planes, n, self.kind)

    def ids(self, begin: int, end: int) -> np.ndarray:
        out, at = [np.zeros(0, "<u4")], 0
        for k, (_, n, _) in enumerate(self.chunks):
            if at < end and at + n > begin:
                out.append(self.chunk(k)[max(begin - at, 0) : end - at])
            at += n
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document and its ids; holds one chunk and one document."""
        chunks, held, at = iter(self), b"", 0
        for name, n in self.names.tolist():
            name, n = (None, -1 - n) if n < 0 else (name, n)
            parts, need = [], 4 * n
            while need > len(held) - at:
                parts.append(held[at:])
                need -= len(held) - at
                held, at = next(chunks).tobytes(), 0
            parts.append(held[at : at + need])
            at += need
            yield name, b"".join(parts)


def write_files(docs: DataFrame, where: str, path: str, end_id: int, word_ends: bool = False, kind: str = "bit", doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Writes all documents in order of doc_id, a file for each range; returns range, name, tokens and documents of each file.

    What reaches the driver is one line a file. A lost executor's files are written again, whole.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edges = splits(rows, "doc_id", partitions(docs.sparkSession))
    close = np.array([end_id], "<u4").tobytes()

    def write(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counted = encoder(path, word_ends), [0, 0]
        given = batches(given)
        first = next(given, None)
        if first is None:
            return
        name = f"{where}/ids-{TaskContext.get().partitionId():08d}.planes"

        def documents():
            batch = first
            while batch is not None:
                names = batch.column(0).to_pylist()
                texts = batch.column(1).to_pylist()
                for begin in range(0, len(texts), 256):
                    for key, ids in zip(names[begin : begin + 256], encode.encode(texts[begin : begin + 256])):
                        counted[0] += len(ids) // 4 + 1
                        counted[1] += 1
                        yield key, ids + close
                batch = next(given, None)

        write_once(name, file_of(documents(), kind))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": pa.array([name]), "tokens": pa.array([counted[0]], pa.int64()), "documents": pa.array([counted[1]], pa.int64())})

    dealt = rows.withColumn("bucket", bucket_of(F.col("doc_id"), edges).cast("int")).repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("doc_id", "text").drop("bucket")
    return sorted(tuple(r) for r in dealt.mapInArrow(write, "part bigint, name string, tokens bigint, documents bigint").collect())


def read_files(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document, from the files: doc_id, ids of all documents before it, ids, and their checksum."""
    if not files:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    before, lines = 0, []
    for part, name, tokens, _ in files:
        lines.append((part, name, before))
        before += tokens

    def read(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out = [[], [], [], []]
                files, path = open_fs(name)
                with files.open_input_file(path) as source:
                    for key, ids in TokenFile(source).documents():
                        for column, value in zip(out, (key, start, len(ids) // 4, zlib.crc32(ids))):
                            column.append(value)
                        start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file
    names = spark.createDataFrame([(k, *line[1:]) for k, line in enumerate(lines)], "part int, name string, start bigint").repartitionById(len(lines), F.col("part"))
    return names.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str, end_id: int, word_ends: bool = False, kind: str = "bit") -> DataFrame:
    """Writes the documents below the shared folder and returns what the files hold."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, new_dir(spark, "tokens"), path, end_id, word_ends, kind))
