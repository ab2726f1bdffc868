"""WARC archives, compressed by record with a dictionary in a leading skippable frame.

A zstandard dictionary is built from a bounded sample of records, and put at the head of every
archive in a skippable frame (magic 0x184D2A5D); each record is then a frame of its own, so a
reader needs nothing but the file and may begin at any record. Of records with equal payloads of
at least ``REVISIT`` bytes that with the smallest id is a response; the others are revisit
records, which name it and carry no payload. Rows that repeat that smallest id are all responses.
Null payloads count as empty. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import batches, new_dir, open_fs, write_once

SKIPPABLE = 0x184D2A5D
#: Smallest payload, in bytes, that is revisited.
REVISIT = 100
#: The dictionary: its bytes, and the most records and the most bytes of each that it is built from.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 65_536, 400, 16_384
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit record without."""
    kind = "response" if refers_to is None else "revisit"
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Bytes: {len(payload)}"]
    body = b"" if refers_to is not None else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-case name, and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return fields, rest[:length]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from records; plain content where there is too little of them for training."""
    if sum(map(len, samples)) > 8 * 1024 and len(samples) >= 10:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 8), samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY:]


def head_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


class Archive:
    """Reads the records of an archive in turn, with the dictionary that it carries; holds one record."""

    def __init__(self, source, block: int = 1 << 20):
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError("no dictionary at the head of the archive")
        self.source, self.block = source, block
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        rest = b""
        while True:
            rest = rest or self.source.read(self.block)
            if not rest:
                return
            one, parts = self.unpack.decompressobj(), []
            while not one.eof:
                if not rest and not (rest := self.source.read(self.block)):
                    raise ValueError("an archive that ends inside a record")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield parsed(b"".join(parts))


def write_archives(pages: DataFrame, where: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> list[tuple[str, int]]:
    """Writes a record for each row; returns the archives' names and numbers of records (one line for each task reaches the driver)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    marked = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # who refers to whom is found on digests alone; payloads are exchanged by page, so that a frequent one fills no task
    slim = marked.where(F.octet_length("html") >= REVISIT).select(F.col("page_id").alias("i"), F.col("digest").alias("d"))
    firsts = slim.groupBy("d").agg(F.min("i").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = slim.join(firsts, "d").where("i != first_id").distinct()
    linked = (
        marked.join(again, (F.col("page_id") == F.col("i")) & (F.col("digest") == F.col("d")), "left")
        .select("page_id", "url", "html", "digest", F.col("first_id").alias("refers_to"))
    )
    # the dictionary's pieces are drawn by hash over the whole table, from anywhere in a payload
    lot, n = F.xxhash64("page_id", "url"), max(1, rows.count())
    begin = F.pmod(F.xxhash64("page_id"), F.greatest(F.length("html") - SAMPLE_BYTES, F.lit(0)) + 1).cast("int") + 1
    sample = rows.where(F.pmod(lot, F.lit(n)) < SAMPLE).limit(4 * SAMPLE).select("page_id", "url", F.substring("html", begin, F.lit(SAMPLE_BYTES)).alias("html")).collect()
    dictionary = build_dictionary([record(r["page_id"], r["url"], r["html"].encode(), "0" * 64, None) for r in sample])
    shared = spark.sparkContext.broadcast(dictionary)

    def write(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = batches(given)
        first = next(given, None)
        if first is None:
            return
        name, counted = f"{where}/pages-{TaskContext.get().partitionId():08d}.warc.zst", [0]

        def frames() -> Iterator[bytes]:
            yield head_frame(shared.value)
            pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value))
            batch = first
            while batch is not None:
                for key, address, text, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    counted[0] += 1
                    yield pack.compress(record(key, address, text.encode(), digest, refers_to))
                batch = next(given, None)

        write_once(name, frames())
        yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "records": pa.array([counted[0]], pa.int64())})

    return sorted(tuple(r) for r in linked.mapInArrow(write, "name string, records bigint").collect())


def read_archives(spark, archives: list[tuple[str, int]]) -> DataFrame:
    """A row per record; the digest of a response is taken from its payload and must be that of its header."""
    if not archives:
        return spark.createDataFrame([], SCHEMA)

    def read(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            for name in batch.column(1).to_pylist():
                out = [[], [], [], [], []]
                files, path = open_fs(name)
                with files.open_input_stream(path, compression=None) as source:
                    for fields, payload in Archive(source):
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload of another digest than its record says")
                        key = fields["warc-record-id"][len("<urn:page:") : -1]
                        to = fields.get("warc-refers-to")
                        size = int(fields["warc-payload-bytes"]) if kind == "revisit" else len(payload)
                        for column, value in zip(out, (int(key) if key else None, size, digest, kind, int(to[len("<urn:page:") : -1]) if to else None)):
                            column.append(value)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(archives)], "part int, name string").repartitionById(len(archives), F.col("part"))
    return names.mapInArrow(read, SCHEMA)


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages below the shared folder and returns what the archives hold."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_dir(spark, "archives")))
