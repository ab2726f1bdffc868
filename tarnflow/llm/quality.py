"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

A text's symbols are its words' characters, two at a time, a word's end among them, and one symbol
that stands for a word that repeats the word before it. A symbol is predicted from the ``ORDER`` - 1
before it, over the borders of words. For every language with enough trusted labelled documents there is a model of
its own, and one of all for the rest; each is trained on about ``TRUSTED`` documents drawn by a hash
of their id (documented bound; fewer if there are fewer).

N-grams are dealt into ``SHARDS`` by the two symbols before the last, so that an n-gram, all its
suffixes and contexts of two symbols or more are in one shard: counts and continuation counts are
made shard by shard, and single symbols, pairs and discounts once for each model. A block of
documents sends the distinct n-grams of each shard with the documents that hold them, and how
often, to the shard's counts; what comes back is a partial sum for each document. So neither counts
nor texts meet anywhere as a whole: no model is on the driver and none is broadcast, and the lines
of a shard are read one after another. Frequent models are dealt several times, by block.

A document is rejected when its perplexity is above the threshold of its language: halfway, in
logarithms, between the ``HIGH`` quantile of trusted labelled documents and the ``LOW`` quantile of
rejected ones, or, where these overlap or too few are labelled, the ``TAIL`` quantile of the
trusted. The quantiles cover all labelled documents. Languages without labels use all languages'.

Documents without words (null, empty, white space) have no perplexity and are rejected. Rows that
repeat an id are judged each by its own text; of labels that repeat an id the lowest counts. A null
language is one without a name. An empty table gives no rows; without trusted labels every text has
a perplexity of one and nothing is rejected but documents without words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import batches, mix64, partitions, written

ORDER = 3
#: Trusted documents that a model is trained on; fewest for a language of its own; shards of a model; characters that are worked on at a time; documents of a block; ids that may be broadcast.
TRUSTED, FEWEST, SHARDS, CHUNK, BLOCK_DOCS, FEW_IDS = 3000, 50, 16, 2_000_000, 50_000, 1_000_000
HIGH, LOW, TAIL, FEWEST_LABELS = 0.995, 0.05, 0.9995, 20
#: Characters beyond the texts' (two code points that never stand for one): a text's beginning, a repeated word; and the symbol of the beginning.
BEGIN, REPEAT = 0x10FFFE, 0x10FFFF
START = np.uint64(BEGIN << 21)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- n-grams
def stream(text: str | None) -> str:
    """A text's characters, with marks of its beginning, one space after each word, and a sign for words that repeat the one before; empty if it has no words."""
    words = (text or "").replace(chr(BEGIN), " ").replace(chr(REPEAT), " ").split()
    if not words:
        return ""
    again = chr(REPEAT)
    return chr(BEGIN) * (ORDER - 1) + " ".join([words[0], *(again if a == b else b for a, b in zip(words, words[1:]))]) + " "


def symbols_of(streams: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct symbols of streams, in order, each symbol's number among them, marks of beginning included, and where each stream's end: pairs of characters from each word's first, a single one before the next word."""
    code = np.frombuffer("".join(streams).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([0, *map(len, streams)])[1:]
    mark = code == BEGIN
    first = mark.copy()
    first[1:] |= (code[:-1] == 32) | mark[:-1]
    place = np.arange(len(code), dtype=np.int32)
    place -= np.maximum.accumulate(np.where(first, place, np.int32(0)))
    begins = np.flatnonzero(place & 1 == 0)
    follow = np.minimum(begins + 1, len(code) - 1)
    single = first[follow] | (begins == len(code) - 1)
    there = np.zeros(REPEAT + 1, bool)
    there[code] = True
    letters = np.r_[0, np.flatnonzero(there)]
    number = np.cumsum(there, dtype=np.int32)
    pair = number[code[begins]].astype(np.int64) * len(letters) + np.where(single, 0, number[code[follow]])
    if len(letters) <= 2000:
        used = np.zeros(len(letters) ** 2, bool)
        used[pair] = True
        known, numbers = np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[pair]
    else:
        known, numbers = np.unique(pair, return_inverse=True)
    return letters[known // len(letters)].astype(np.uint64) << np.uint64(21) | letters[known % len(letters)].astype(np.uint64), numbers.astype(np.int32), np.searchsorted(begins, ends)


def ranked(columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers that order columns of small numbers as these themselves, and are equal where they are; and how many bits they take."""
    bits = max(1, int(columns.max(initial=0)).bit_length())
    if bits * len(columns) <= 62:
        out = columns[0].astype(np.int64)
        for row in columns[1:]:
            out <<= bits
            out |= row
        return out, bits * len(columns)
    half = len(columns) // 2
    left, right = (np.unique(ranked(part)[0], return_inverse=True)[1].astype(np.int64) for part in (columns[:half], columns[half:]))
    wide = max(1, int(right.max(initial=0)).bit_length())
    return left << wide | right, wide + max(1, int(left.max(initial=0)).bit_length())


def in_order(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of columns of small numbers in their order and then that of the places; and which of these differ from the one before."""
    key, bits = ranked(columns)
    wide = max(1, len(key).bit_length())
    if bits + wide <= 63:  # one sort of single numbers
        both = np.sort(key << wide | np.arange(len(key)))
        order, key = both & ((1 << wide) - 1), both >> wide
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)


def shard_of(grams: np.ndarray) -> np.ndarray:
    """The shard of n-grams, by the two symbols before the last."""
    return (mix64(mix64(grams[-3]) + grams[-2]) % np.uint64(SHARDS)).astype(np.int64)


def distinct(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, in order, and the sums of their weights, or their number."""
    if not grams.shape[1]:
        return grams, np.zeros(0, np.int64)
    number = np.unique(grams, return_inverse=True)[1].reshape(grams.shape)
    order, new = in_order(number)
    first = np.flatnonzero(new)
    own = grams[:, order[first]]
    return (own, np.diff(np.r_[first, len(order)])) if weights is None else (own, np.add.reduceat(weights[order], first))


def _pack(a: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes as the largest needs (their number comes first), byte by byte, so that what is small takes little."""
    size = next(n for n in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << 8 * n)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(a.astype(f"<u{size}").reshape(-1).view(np.uint8).reshape(-1, size).T.tobytes())


def _load(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{data[0]}").astype(np.int64)


def _packed_grams(known: np.ndarray, numbers: np.ndarray) -> bytes:
    """N-grams, given as numbers of known symbols: how long the symbols that occur are, these, and the numbers of them."""
    used = np.zeros(len(known), bool)
    used[numbers] = True
    symbols = _pack(known[used])
    return len(symbols).to_bytes(8, "little") + symbols + _pack((np.cumsum(used) - 1)[numbers])


def _grams(data: bytes, order: int = ORDER) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return _load(data[8:cut]).astype(np.uint64)[_load(data[cut:])].reshape(order, -1)


def windows(known: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the symbols that are predicted, ``CHUNK`` at a time, and the n-grams that end there, as numbers of the known symbols."""
    at = np.flatnonzero(known[numbers] != START)
    for begin in range(0, len(at), CHUNK):
        some = at[begin : begin + CHUNK]
        yield some, np.stack([numbers[some - k] for k in range(ORDER - 1, -1, -1)])


# ---------------------------------------------------------------- training
def _count_lines(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, text) to the distinct n-grams of each model and shard, and their counts."""
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}

    def lines(model: str) -> Iterator[pa.RecordBatch]:
        known, every, _ = symbols_of(held.pop(model))
        for _, numbers in windows(known, every):
            order, new = in_order(numbers)
            first = np.flatnonzero(new)
            own, counts = numbers[:, order[first]], np.diff(np.r_[first, len(order)])
            shard = shard_of(known[own])
            for s in np.unique(shard).tolist():
                mine = shard == s
                yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([s], pa.int32()), pa.array([_packed_grams(known, own[:, mine])], pa.binary()), pa.array([_pack(counts[mine])], pa.binary())], ["model", "shard", "grams", "counts"])
        sizes.pop(model)

    for batch in batches(given):
        for model, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s := stream(text):
                held.setdefault(model, []).append(s)
                sizes[model] = sizes.get(model, 0) + len(s)
                if sizes[model] >= CHUNK:
                    yield from lines(model)
    for model in list(held):
        yield from lines(model)


def tally(counts: np.ndarray) -> list[int]:
    """How many counts are one, two, three and four."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _count_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A shard's n-grams and counts over all blocks; tallies of orders 3 to ORDER; pairs with the number of symbols before them."""
    grams = np.concatenate([_grams(x) for x in table["grams"].to_pylist()], axis=1)
    grams, counts = distinct(grams, np.concatenate([_load(x) for x in table["counts"].to_pylist()]))
    tallies, level, n = [tally(counts)], grams, counts
    while len(level) > 3:
        level, n = distinct(level[1:])
        tallies.append(tally(n))
    pairs, before = distinct(level[1:])
    return pa.table({
        "model": pa.array([key[0].as_py()]), "shard": pa.array([key[1].as_py()], pa.int32()), "grams": pa.array([_packed_grams(*np.unique(grams, return_inverse=True))], pa.binary()), "counts": pa.array([_pack(counts)], pa.binary()),
        "tallies": pa.array([np.array(tallies[::-1], np.int64).tobytes()], pa.binary()), "pairs": pa.array([_packed_grams(*np.unique(pairs, return_inverse=True))], pa.binary()), "before": pa.array([_pack(before)], pa.binary()),
    })


def _base(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A model's pairs with their continuation counts, and the tallies of all orders."""
    pairs = np.concatenate([_grams(x, 2) for x in table["pairs"].to_pylist()], axis=1)
    pairs, n = distinct(pairs, np.concatenate([_load(x) for x in table["before"].to_pylist()]))
    upper = sum(np.frombuffer(x, np.int64).reshape(-1, 4) for x in table["tallies"].to_pylist())
    tallies = np.concatenate([[tally(distinct(pairs[1:])[1]), tally(n)], upper])
    return pa.table({"model": pa.array([key[0].as_py()]), "pairs": pa.array([_packed_grams(*np.unique(pairs, return_inverse=True))], pa.binary()), "before": pa.array([_pack(n)], pa.binary()), "tallies": pa.array([tallies.astype(np.int64).tobytes()], pa.binary())})


def discounts(n: list[int]) -> np.ndarray:
    """What counts of nought, one, two and three or more are lowered by, from how many counts are one to four."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return np.clip([0, 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)], [0, 0.05, 0.1, 0.1], [0, 0.95, 1.9, 2.9])


class Shard:
    """Probabilities of the n-grams of a shard, and weights of their contexts, by hashes of the symbols."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, before: np.ndarray, tallies: np.ndarray):
        levels = [distinct(pairs[1:]), (pairs, before)]
        upper, n = [(grams, counts)], grams
        while len(n) > 3:
            n, c = distinct(n[1:])
            upper.append((n, c))
        levels += upper[::-1]
        self.floor = 1.0 / (levels[0][0].shape[1] + 1)
        self.levels = []
        for (symbols, c), tallied in zip(levels, tallies.tolist()):
            key, context = (x[-1] for x in hashes(symbols))
            d = discounts(tallied)[np.minimum(c, 3)]
            ctx, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, weights=c, minlength=len(ctx))
            order = np.argsort(key)
            own = (c - d) / total[where] if len(c) else np.zeros(0)
            self.levels.append((key[order], own[order], ctx, np.bincount(where, weights=d, minlength=len(ctx)) / total))

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """The probability of each n-gram's last symbol after the others, from the lowest order up."""
        keys, contexts = hashes(grams)
        p = np.full(grams.shape[1], self.floor)
        for (key, own, ctx, gamma), k, c in zip(self.levels, keys, contexts):
            if len(ctx):
                at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                there = np.minimum(np.searchsorted(key, k), len(key) - 1)
                p = np.where(ctx[at] == c, np.where(key[there] == k, own[there], 0.0) + gamma[at] * p, p)
        return p


def hashes(grams: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the last one, two, ... symbols of n-grams, and of those without the very last."""
    symbols = mix64(grams)
    context, keys, contexts = np.full(grams.shape[1], 1, np.uint64), [], []
    for n in range(len(grams)):
        contexts.append(context)
        keys.append(mix64(context * _STEP + symbols[-1] + np.uint64(n + 1 << 32)))
        if n + 1 < len(grams):
            context = mix64(context * _STEP + symbols[-2 - n])
    return keys, contexts


# ---------------------------------------------------------------- scoring
def _event_lines(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to lines of blocks of one language: the documents (shard -1), and each shard's distinct n-grams with the documents that hold them and how often."""
    part, turn = TaskContext.get().partitionId() << 24, 0
    held: dict[str | None, list[tuple]] = {}
    sizes: dict[str | None, int] = {}
    names = ["block", "lang", "shard", "ids", "marks", "sizes", "grams", "runs", "docs", "times"]
    longs = pa.list_(pa.int64())

    def line(lang: str | None, shard: int, ids: list | None, marks: list | None, n: list | None, *data: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part + turn], pa.int64()), pa.array([lang], pa.string()), pa.array([shard], pa.int32()), pa.array([ids], longs), pa.array([marks], longs), pa.array([n], longs), *(pa.array([x], pa.binary()) for x in data)], names)

    def block(lang: str | None) -> Iterator[pa.RecordBatch]:
        nonlocal turn
        rows, _ = held.pop(lang), sizes.pop(lang)
        known, every, ends = symbols_of([s for _, _, s in rows])
        wide = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(rows)), wide)
        yield line(lang, -1, [r[0] for r in rows], [r[1] for r in rows], np.maximum(0, wide - ORDER + 1).tolist(), None, None, None, None)
        for at, numbers in windows(known, every):
            order, new = in_order(numbers)
            doc = owner[at[order]]
            pair = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]])
            times = np.diff(np.r_[pair, len(order)])
            first = np.flatnonzero(new[pair])
            runs = np.diff(np.r_[first, len(pair)])
            own = numbers[:, order[pair[first]]]
            # documents of an n-gram: the first, then how far on the next is
            shard, docs = shard_of(known[own]), doc[pair]
            docs[1:] -= np.where(new[pair[1:]], 0, docs[:-1])
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                lot = np.repeat(first[mine] - (np.cumsum(runs[mine]) - runs[mine]), runs[mine]) + np.arange(int(runs[mine].sum()))
                yield line(lang, s, None, None, None, _packed_grams(known, own[:, mine]), _pack(runs[mine]), _pack(docs[lot]), _pack(times[lot]))
        turn += 1

    for batch in batches(given):
        for doc_id, lang, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
            s = stream(text)
            held.setdefault(lang, []).append((doc_id, mark, s))
            sizes[lang] = sizes.get(lang, 0) + len(s)
            if sizes[lang] >= CHUNK or len(held[lang]) >= BLOCK_DOCS:
                yield from block(lang)
            elif len(held) > 1 and sum(sizes.values()) >= 2 * CHUNK:
                yield from block(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from block(lang)


EVENT_SCHEMA = "block bigint, lang string, shard int, ids array<bigint>, marks array<bigint>, sizes array<bigint>, grams binary, runs binary, docs binary, times binary"


def _sum_lines(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that come sorted by model, shard and salt, the shard's counts first, to the documents' partial sums; one shard and one line are held."""
    shard: Shard | None = None
    for batch in batches(given):
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["kind"] == 0:
                grams = _grams(row["grams"]) if row["grams"] is not None else np.zeros((ORDER, 0), np.uint64)
                counts = _load(row["counts"]) if row["grams"] is not None else np.zeros(0, np.int64)
                shard = Shard(grams, counts, _grams(row["pairs"], 2), _load(row["before"]), np.frombuffer(row["tallies"], np.int64).reshape(-1, 4))
                continue
            sums = None
            if row["shard"] >= 0:
                logs = np.log(shard.probabilities(_grams(row["grams"])))
                runs, docs, times = (_load(row[k]) for k in ("runs", "docs", "times"))
                until = np.cumsum(docs)
                first = np.cumsum(runs) - runs
                docs = until - np.repeat(until[first] - docs[first], runs)
                sums = np.bincount(docs, weights=np.repeat(logs, runs) * times).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(n).slice(k, 1) for n in ("block", "lang", "shard", "ids", "marks", "sizes")] + [pa.array([sums], pa.binary())], ["block", "lang", "shard", "ids", "marks", "sizes", "sums"])


SUM_SCHEMA = "block bigint, lang string, shard int, ids array<bigint>, marks array<bigint>, sizes array<bigint>, sums binary"


def _perplexities(table: pa.Table) -> pa.Table:
    """A block's documents with their perplexities, from its lines."""
    table = table.sort_by("shard")  # the documents' line first, and sums always in one order
    first = table.slice(0, 1).to_pylist()[0]
    n = np.array(first["sizes"], np.int64)
    total = np.zeros(len(n))
    for data in table["sums"].to_pylist()[1:]:
        part = np.frombuffer(data, np.float64)
        total[: len(part)] += part
    value = np.exp(np.minimum(700.0, -total / np.maximum(n, 1)))
    return pa.table({"doc_id": pa.array(first["ids"], pa.int64()), "lang": pa.array([first["lang"]] * len(n), pa.string()), "mark": pa.array(first["marks"], pa.int64()), "perplexity": pa.array(value, mask=n == 0)})


def _labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and a mark, which tells texts and languages of one id apart."""
    lang, text = F.col("lang").cast("string"), F.col("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("mark"))


def counted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(counts by model and shard; pairs and tallies by model) of the trusted documents; none without any. The model of all has an empty name."""
    slim = _rows(docs).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    good = slim.join(_labels(labels).where("quality = 1").select("doc_id"), "doc_id").distinct()
    good = written(good, "trusted")
    total = good.select("doc_id").distinct().count()
    if not total:
        return None
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = (
        good.join(good.groupBy("lang").agg(F.countDistinct("doc_id").alias("n")), "lang")
        .select("doc_id", "lang", ((F.col("n") >= FEWEST) & (F.col("lang") != "") & (lot < F.lit(float(TRUSTED)) / F.col("n"))).alias("own"), (lot < TRUSTED / total).alias("all")).where("own or all")
    )
    drawn = written(drawn, "drawn")
    given = _rows(docs).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    # about TRUSTED ids for each language: broadcast if they are few enough
    text = given.join(F.broadcast(drawn) if drawn.count() <= FEW_IDS else drawn, ["doc_id", "lang"])
    trusted = text.withColumn("model", F.explode(F.expr("filter(array(if(own, lang, null), if(all, '', null)), x -> x is not null)"))).select("model", "text")
    lines = trusted.mapInArrow(_count_lines, "model string, shard int, grams binary, counts binary")
    counts = written(lines.groupBy("model", "shard").applyInArrow(_count_sums, "model string, shard int, grams binary, counts binary, tallies binary, pairs binary, before binary"), "counts")
    base = counts.select("model", "tallies", "pairs", "before").groupBy("model").applyInArrow(_base, "model string, pairs binary, before binary, tallies binary")
    return counts.select("model", "shard", "grams", "counts"), written(base, "models")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, mark and perplexity of every document."""
    found = counted(docs, labels)
    if found is None:
        return _rows(docs).select("doc_id", "lang", "mark", F.when(F.col("text").rlike(r"\S"), F.lit(1.0)).alias("perplexity"))
    counts, base = found
    models = base.count()
    salts = max(1, -(-4 * partitions(docs.sparkSession) // (models * SHARDS)))
    blank = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    dealt = (
        base.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1)))).join(counts, ["model", "shard"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select("model", "shard", "salt", F.lit(0).alias("kind"), *blank("bigint", "block"), *blank("string", "lang"), *blank("array<bigint>", "ids", "marks", "sizes"), "grams", "counts", "pairs", "before", "tallies", *blank("binary", "runs", "docs", "times"))
    )
    events = _rows(docs).mapInArrow(_event_lines, EVENT_SCHEMA)
    events = (
        events.join(base.select(F.col("model").alias("name")), F.col("lang") == F.col("name"), "left")
        .select(F.coalesce("name", F.lit("")).alias("model"), "shard", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "block", "lang", "ids", "marks", "sizes", "grams", *blank("binary", "counts", "pairs", "before", "tallies"), "runs", "docs", "times")
    )
    lines = dealt.unionByName(events).repartition("model", "shard", "salt").sortWithinPartitions("model", "shard", "salt", "kind")
    return lines.mapInArrow(_sum_lines, SUM_SCHEMA).groupBy("block", "lang").applyInArrow(_perplexities, "doc_id bigint, lang string, mark bigint, perplexity double")


def thresholds(scores: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(lang, threshold) of languages with enough labels, and the threshold of all, from the perplexities of all labelled documents."""
    at = lambda good, q: F.percentile_approx(F.when(F.col("quality") == good, F.col("perplexity")), q, 10_000)
    joined = scores.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "perplexity").where("perplexity is not null").join(_labels(labels), "doc_id")
    lines = joined.rollup("lang").agg(F.grouping("lang").alias("whole"), at(1, HIGH).alias("high"), at(1, TAIL).alias("tail"), at(0, LOW).alias("low"), F.count_if(F.col("quality") == 1).alias("n1"), F.count_if(F.col("quality") == 0).alias("n0"))
    apart = (F.col("n0") >= FEWEST_LABELS) & (F.col("low") > F.col("high"))
    lines = written(lines.select("lang", "whole", "n1", F.when(apart, F.sqrt(F.col("low") * F.col("high"))).otherwise(F.col("tail")).alias("threshold")), "thresholds")
    of_all = lines.where("whole = 1").first()
    return lines.where(f"whole = 0 and n1 >= {FEWEST_LABELS}").select(F.col("lang").alias("of"), F.col("threshold").alias("own")), of_all["threshold"] if of_all and of_all["threshold"] is not None else math.inf


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scores = written(scored(docs, labels), "perplexities")
    limits, of_all = thresholds(scores, labels)
    found = scores.join(limits, F.coalesce("lang", F.lit("")) == F.col("of"), "left").withColumn("threshold", F.coalesce("own", F.lit(of_all)))
    return found.select("doc_id", "lang", "mark", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep of every document."""
    return _judged(docs, labels).drop("mark")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, whatever these are named. Texts are exchanged once, by id, at every size of the input."""
    lang, text = F.col("lang").cast("string"), F.col("text")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("i"), F.xxhash64(lang, text).alias("m"))
    out = _judged(docs, labels).where("not keep").select(F.col("doc_id").alias("j"), F.col("mark").alias("o")).distinct().hint("merge")
    return rows.join(out, F.col("i").eqNullSafe(F.col("j")) & (F.col("m") == F.col("o")), "left_anti").select("row.*")
