"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct word shingles. Its sketch has a fixed number of coordinates,
filled in rounds: in the first rounds every element is hashed to a coordinate and a value, the
smallest value of the earliest round staying; in the later rounds, one for each coordinate, every
element bids for that one, so that all are filled at last. Two sketches agree at each coordinate
with the sets' similarity as probability, and the number of agreements is concentrated.

Documents with equal sets are one class at once. Classes that agree on all coordinates of a band
share a bucket. Links are confirmed on the full sets: first between members and a member of each
bucket that is drawn by hash, most promising pairs first and only while they may still join two
components; then, in the buckets that still hold several components, between all members of
different components whose sizes and sketches allow a link. So no bucket that is one component already costs
its pairs, and none is capped. At a similarity of 0.8, bands of 5 in 32 miss a pair with
probability 3e-6.

Documents without words (null, empty, white space) have an empty set and are alone. Rows that
repeat a doc_id are documents of their own. A row without an id takes part by its text: it is in the
component of the smallest id that it is linked with, and kept, with no component, where it has none.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm.common import LOWER, batches, deleted, mix64, slices, text_buffer, word_hashes, word_spans, written
from tarnflow.llm.graphs import components

#: Coordinates of a band and bands of a sketch.
ROWS, BANDS = 5, 32
#: Members of a block: a bucket of more is compared block by block.
BLOCK = 512
_VALUE = np.uint64(44)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, sorted by both; a row of fewer words has its whole sequence as the one."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(data, starts, ends)
    n = np.bincount(row, minlength=len(offsets) - 1)
    full = np.zeros(0, np.int64)
    if len(h) >= words:
        full = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :])
    joined = np.full(len(full), words, np.uint64)
    for k in range(words):
        joined = mix64(joined * _STEP + h[full + k])
    rows, hashes = [row[full]], [joined]
    first = np.cumsum(n) - n
    for size in range(1, words):
        short = np.flatnonzero(n == size)
        if len(short):
            one = np.full(len(short), size, np.uint64)
            for k in range(size):
                one = mix64(one * _STEP + h[first[short] + k])
            rows.append(short)
            hashes.append(one)
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashes, rows)) if len(rows) < 2**16 else _sorted_by_row(rows, hashes)
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _sorted_by_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    order = np.argsort(hashes)
    return order[np.argsort(rows[order], kind="stable")]


def sketches(rows: np.ndarray, hashes: np.ndarray, n: int, size: int) -> np.ndarray:
    """A sketch of ``size`` coordinates for each of n rows, from their sorted sets; rows without elements stay at zero."""
    out = np.zeros(n * size, np.uint64)
    filled = np.zeros(n * size, bool)
    wanted = np.zeros(n, bool)
    wanted[rows] = True
    low = np.uint64((1 << 44) - 1)
    for turn in range(2 * size):
        if not len(rows):
            break
        g = mix64(hashes + np.uint64((turn + 1) * int(_STEP) % 2**64))
        value = g & low
        if turn < size:
            bins = ((g >> _VALUE) % np.uint64(size)).astype(np.int64)
            key = rows * size + bins
        else:
            key = rows * size + (turn - size)
        free = ~filled[key]
        key, value = key[free], value[free]
        if len(key):
            lots = np.unique(key)
            place = np.full(len(lots), low, np.uint64)
            np.minimum.at(place, np.searchsorted(lots, key), value)
            out[lots] = place + np.uint64(1)
            filled[lots] = True
            open_rows = ~filled.reshape(n, size).all(axis=1) & wanted
            if not open_rows[rows].all():
                still = open_rows[rows]
                rows, hashes = rows[still], hashes[still]
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch; bands don't share keys."""
    n, size = sketch.shape
    bands = sketch.reshape(n, size // rows, rows)
    h = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64), (n, size // rows)).copy()
    for k in range(rows):
        h = mix64(h * _STEP + bands[:, :, k])
    return h.view(np.int64)


def _sketch_table(docs: DataFrame, words: int, rows_: int, bands: int) -> DataFrame:
    size = rows_ * bands

    def walk(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            data, offsets = text_buffer(batch.column(1))
            for begin, end in slices(offsets):
                part = offsets[begin : end + 1]
                rows, hashes = shingle_sets(data[part[0] : part[-1]], part - part[0], words)
                n = np.bincount(rows, minlength=end - begin)
                keys = band_keys(sketches(rows, hashes, end - begin, size), rows_)
                a, b = np.zeros(end - begin, np.uint64), np.zeros(end - begin, np.uint64)
                if len(rows):
                    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    a[rows[at]] = np.add.reduceat(mix64(hashes), at)
                    b[rows[at]] = np.add.reduceat(mix64(hashes ^ _STEP), at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - begin + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists],
                    ["doc_id", "n", "set_a", "set_b", "bands"],
                )

    return docs.mapInArrow(walk, "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def _set_table(docs: DataFrame, words: int) -> DataFrame:
    def walk(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            data, offsets = text_buffer(batch.column(1))
            for begin, end in slices(offsets):
                part = offsets[begin : end + 1]
                rows, hashes = shingle_sets(data[part[0] : part[-1]], part - part[0], words)
                cut = np.searchsorted(rows, np.arange(end - begin + 1))
                sets = [hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sets, pa.binary())], ["id", "elements"])

    return docs.mapInArrow(walk, "id bigint, elements binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as a written table."""

    def walk(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            keep = [similar(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("p"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("q"))
    return written(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(walk, "a bigint, b bigint"), "links")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after new links, which are contracted to components first."""
    mine = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    other = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = links.join(mine, "a").join(other, "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(joined).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    return written(labels.join(merged, "component", "left").select("id", F.coalesce("merged", "component").alias("component")), "labels")


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs between different components."""
    mine = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    other = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(mine, "a").join(other, "b").where("ca != cb").drop("ca", "cb")


def _members(given: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come sorted by their first three columns, gathered by them; a gathering holds two blocks at most."""
    key, held = None, []
    for batch in batches(given):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if held:
                    yield key, held
                key, held = row[:3], []
            held.append(row[3:])
    if held:
        yield key, held


def _blocked(placed: DataFrame, *payload: str) -> DataFrame:
    """Buckets (key, id, m, ...) as pairs of blocks of up to ``BLOCK`` members, a pair's rows in one task and together."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    laid = placed.withColumn("own", own).withColumn("ij", F.explode(pairs))
    return laid.select("key", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "own", "id", "component", *payload).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _agreeing(block: tuple, members: list[tuple], sketch: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of different components and, in a pair of unlike blocks, of different blocks that may be similar: sizes allow it, and the sketches agree at five and a half deviations below what they should."""
    size = sketch.shape[1]
    least = size * percent / 100 - 5.5 * (size * percent / 100 * (1 - percent / 100)) ** 0.5
    component = np.array([m[2] for m in members])
    own = np.array([m[0] for m in members])
    left, right, agreed = [], [], []
    for k in range(len(members) - 1):
        other = np.flatnonzero((component[k + 1 :] != component[k]) & (100 * np.minimum(sizes[k + 1 :], sizes[k]) >= percent * np.maximum(sizes[k + 1 :], sizes[k]))) + k + 1
        if block[1] != block[2]:
            other = other[own[other] != own[k]]
        if len(other):
            same = (sketch[other] == sketch[k]).sum(axis=1)
            near = same >= least
            left.append(np.full(int(near.sum()), k))
            right.append(other[near])
            agreed.append(same[near])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(agreed)


def _crossed(shared_keys: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Labels after all links between components that still share a bucket have been sought.

    First the sketches tell which members of such a bucket may have a link at all; only their sets
    are then compared, within pairs of blocks, most agreeing pairs first, and no more once two
    components are one. Neither step gives out pairs that aren't links.
    """
    placed = shared_keys.join(labels, "id")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")).where("x != y").select("key", "m")
    rest = written(placed.join(mixed, "key"), "mixed")

    def sketch(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(given):
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                coordinates, n = _coordinates(part.column(1).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in coordinates], pa.binary()), pa.array(n)], ["id", "sketch", "size"])

    def hopeful(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _members(given):
            coordinates = np.frombuffer(b"".join(m[3] for m in members), np.uint16).reshape(len(members), size)
            left, right, _ = _agreeing(key, members, coordinates, np.array([m[4] for m in members]), percent)
            ids = sorted({members[k][1] for k in np.union1d(left, right).tolist()})
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(ids), pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])

    def linked(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _members(given):
            elements = [m[3] for m in members]
            coordinates, n = _coordinates(elements, size)
            left, right, agreed = _agreeing(key, members, coordinates, n, percent)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = root.get(y, y)
                    x = y
                return x

            found = []
            for k in np.argsort(-agreed, kind="stable").tolist():
                a, b = members[left[k]], members[right[k]]
                x, y = find(a[2]), find(b[2])
                if x != y and similar(a[3], b[3], percent):
                    root[max(x, y)] = min(x, y)
                    found.append((a[1], b[1]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    sketched = written(sets.join(rest.select("id").distinct(), "id", "left_semi").mapInArrow(sketch, "id bigint, sketch binary, size bigint"), "contested")
    hope = written(_blocked(rest.join(sketched, "id"), "sketch", "size").mapInArrow(hopeful, "key bigint, id bigint").distinct(), "hopeful")
    sized = hope.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    laid = hope.join(sized, "key").join(labels, "id").join(sets, "id")
    links = written(_blocked(laid, "elements").mapInArrow(linked, "a bigint, b bigint"), "links")
    return labels if links.isEmpty() else _relabelled(labels, links)


def _coordinates(elements: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of sets, a coordinate in 16 bits, and the sets' sizes."""
    n = np.array([len(e) // 8 for e in elements], np.int64)
    hashes = np.frombuffer(b"".join(elements), np.uint64)
    return sketches(np.repeat(np.arange(len(n)), n), hashes, len(n), size).astype(np.uint16), n


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sorted sets have 100 x shared >= percent x united elements."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; documents are linked where 100 x shared >= percent x united shingles."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = written(_sketch_table(given, words, rows, bands), "sketches")
    classes = written(table.where("n > 0").groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    laid = classes.select("id", "n", F.explode("bands").alias("key"))
    drawn = laid.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("lot"), "id", "n")).alias("d"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.col("d.id").alias("other"), F.col("d.n").alias("n_other"))
    fits = lambda n, m: (100 * F.least(n, m) >= percent * F.greatest(n, m))
    starred = (
        laid.join(drawn, "key").where((F.col("id") != F.col("other")) & fits(F.col("n"), F.col("n_other")))
        .groupBy(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    )
    pairs = written(starred, "pairs")
    shared_keys = written(laid.join(drawn.select("key"), "key"), "buckets")
    members = written(shared_keys.select("id").distinct(), "members")
    # equal ids with unlike texts can't be told apart by id: all their sets' elements count, as one
    sets = written(_set_table(given.join(members.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), words), "sets")
    labels = members.select("id", F.col("id").alias("component"))
    left = pairs
    for most in (1, 2, 6, None):
        chosen = left if most is None else left.withColumn("turn", F.row_number().over(W.partitionBy("a").orderBy(F.desc("shared"), "b"))).where(F.col("turn") <= most).drop("turn")
        chosen = written(chosen, "chosen")
        if chosen.isEmpty():
            break
        links = _confirmed(chosen, sets, percent)
        before, labels = labels, _relabelled(labels, links)
        tried, left = left, written(_open(left.join(chosen.select("a", "b"), ["a", "b"], "left_anti"), labels), "open")
        deleted(before, links, chosen, tried)
    labels = _crossed(shared_keys, labels, sets, percent, rows * bands)
    found = classes.select("n", "set_a", "set_b", "id").join(labels, "id", "left").select("n", "set_a", "set_b", F.coalesce("component", "id").alias("component"))
    return (
        table.select("doc_id", "n", "set_a", "set_b").join(found, ["n", "set_a", "set_b"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates, all columns kept, whatever these are named: of each group that of the smallest id, and of rows that repeat it that of the smallest text.

    Documents without an id are all kept.
    """
    found = near_duplicates(docs, words, percent, doc_id=doc_id, text=text)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("k")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].cast("bigint").alias("i"))
    first = F.row_number().over(W.partitionBy("i").orderBy(F.col("row")[text]))
    ranked = rows.join(kept, rows["i"] == kept["k"], "left_semi").withColumn("turn", first).where("turn = 1").select("row.*")
    return ranked.unionByName(docs.where(docs[doc_id].isNull()))
