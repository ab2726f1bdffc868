"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

Test items are indexed by term, in order of their length and in blocks; every posting carries its
BM25 impact as a share of what the item scores against itself, so one threshold holds for all
items. Every training passage is a query. Documents are dealt into cells of ``CELL`` words; passages
are runs of cells, one from each cell on, as long as it takes for any copy of an item of the block
to lie whole in one of them. A block is skipped where the block maxima of the passage's terms
don't add up to the threshold: first with sums of the cells' terms, for all passages at once, then
with the passage's distinct terms. What is left goes through WAND with block maxima, which finds
every item at or above the threshold.
An item found is verified on five-word shingles: at least 0.8 of its question's and of its
answer's must be in the passage. The answer is what follows the last question mark, or else the
last sentence; the shingles that reach into it are its own. Words are lower-cased runs of letters
and digits, so punctuation neither counts nor hides a copy.

The index goes to the executors in shards of a fixed number of items, and as many passes over the
documents are made as there are groups of shards; so what is broadcast has a fixed bound.

Null and empty texts and items match nothing; items of fewer than five words match as a whole
sequence. Rows that repeat a document or an item are treated each on its own; of items with the
same id and document one row is given. Empty tables give no rows and drop no documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import LOWER, batches, mix64, slices, text_buffer, word_hashes, word_spans

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; share of shingles; words of a shingle.
SCORE, OVERLAP, WORDS = 0.5, 0.8, 5
#: Items of a block and of a shard, shards that are broadcast at a time, and words of a cell.
BLOCK, SHARD, GROUP, CELL = 8, 4096, 16, 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lower case, and ASCII punctuation as spaces: signs stuck to a word don't hide it.
PLAIN = LOWER.copy()
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)")


def hashed(text: str) -> np.ndarray:
    """Hashes of the lower-cased words of a text, punctuation left out."""
    data = PLAIN[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of so many words."""
    if len(h) < words:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - words + 1, words, np.uint64)
    for k in range(words):
        out = mix64(out * _STEP + h[k : len(h) - words + 1 + k])
    return out


def answer_begins(text: str) -> int:
    """Where the answer begins: after the last question mark that isn't at the end, or at the last sentence; 0 if there is one sentence."""
    marks = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    asked = [m for m in marks if text[:m].rstrip().endswith("?")]
    return asked[-1] if asked else marks[-1] if marks else 0


class Shard:
    """Inverted index of up to ``SHARD`` items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], weight: dict[int, float], average: float):
        items = sorted(items, key=lambda x: (len(hashed(x[1])), -(2**63) if x[0] is None else x[0]))
        self.ids = [i for i, _ in items]
        self.question, self.answer, self.width = [], [], []
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            h = hashed(text)
            counts = Counter(h.tolist())
            impact = {t: weight[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(h) / average)) for t, n in counts.items()}
            total = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((k, x / total))
            self.width.append(len(h))
            runs, cut = shingles(h, min(WORDS, len(h))), len(hashed(text[: answer_begins(text)]))
            asks = max(0, cut - min(WORDS, len(h)) + 1) if cut else len(runs)
            self.question.append(np.unique(runs[:asks]))
            self.answer.append(np.unique(runs[asks:]))
        self.terms = np.array(sorted(postings), np.uint64)
        self.postings = [postings[t] for t in self.terms.tolist()]
        blocks = -(-len(items) // BLOCK)
        self.maxima = np.zeros((len(self.terms) + 1, blocks), np.float32)
        for t, line in enumerate(self.postings):
            for k, x in line:
                self.maxima[t, k // BLOCK] = max(self.maxima[t, k // BLOCK], x)
        self.span = [max(self.width[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)]

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """The number of each word's term; words of no item have the number after the last."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, len(self.terms))

    def wand(self, terms: list[int], least: float, begin: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """All items from ``begin`` to below ``end`` whose impacts for these distinct terms add up to ``least``: block-max WAND over the terms' postings."""
        end = len(self.ids) if end is None else end
        cursors = []
        for t in terms:
            if t < len(self.postings):
                line = self.postings[t]
                at = bisect_left(line, (begin,)) if begin else 0
                if at < len(line) and line[at][0] < end:
                    cursors.append([line[at][0], at, t])
        top = {c[2]: float(self.maxima[c[2]].max()) for c in cursors}
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += top[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            block = item // BLOCK
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if sum(float(self.maxima[t, block]) for _, _, t in cursors[: pivot + 1]) < least:
                # no item before the end of the block, or before the next term's, can reach it
                beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                goal, moved = min((block + 1) * BLOCK, max(beyond, item + 1)), cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(self.postings[t][at][1] for i, at, t in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                goal, moved = item + 1, cursors[: pivot + 1]
            else:
                goal, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                line = self.postings[c[2]]
                while c[1] < len(line) and line[c[1]][0] < goal:
                    c[1] += 1
                c[0] = line[c[1]][0] if c[1] < len(line) and line[c[1]][0] < end else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def matches(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """Row, item, score and overlaps of every verified match in rows of word hashes."""
        if not len(h) or not len(self.terms):
            return
        term, n = self.term_of(h), np.diff(offsets)
        per_row = -(-n // CELL)
        first = np.cumsum(per_row) - per_row
        row = np.repeat(np.arange(len(n)), n)
        cell = first[row] + (np.arange(len(h)) - offsets[row]) // CELL
        cells = int(per_row.sum())
        # the distinct terms of each cell, and their block maxima
        known = term < len(self.terms)
        key = np.unique(cell[known] * (len(self.terms) + 1) + term[known])
        mass = np.zeros((cells + 1, self.maxima.shape[1]))
        if len(key):
            of = key // (len(self.terms) + 1)
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            mass[of[begins] + 1] = np.add.reduceat(self.maxima[key % (len(self.terms) + 1)], begins, axis=0)
        np.cumsum(mass, axis=0, out=mass)
        last = (first + per_row)[np.repeat(np.arange(len(n)), per_row)]
        owner = np.repeat(np.arange(len(n)), per_row)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        wide = np.array([-(-(s - 1) // CELL) + 1 for s in self.span])
        for width in sorted(set(wide.tolist())):
            blocks = np.flatnonzero(wide == width)
            begin = np.arange(cells)
            end = np.minimum(begin + width, last)
            bound = mass[end][:, blocks] - mass[begin][:, blocks]
            for k in np.flatnonzero((bound >= SCORE - 1e-6).any(axis=1)).tolist():
                r = int(owner[k])
                a = int(offsets[r] + (k - first[r]) * CELL)
                z = int(min(offsets[r] + (end[k] - first[r]) * CELL, offsets[r + 1]))
                terms = np.unique(term[a:z])
                near = blocks[bound[k] >= SCORE - 1e-6]
                for b in near[self.maxima[terms][:, near].sum(axis=0) >= SCORE - 1e-6].tolist():
                    for item, score in self.wand(terms.tolist(), SCORE, b * BLOCK, (b + 1) * BLOCK):
                        runs = shingles(h[a:z], min(WORDS, self.width[item]))
                        asked = float(np.isin(self.question[item], runs).mean()) if len(self.question[item]) else 1.0
                        answered = float(np.isin(self.answer[item], runs).mean()) if len(self.answer[item]) else 1.0
                        if asked >= OVERLAP and answered >= OVERLAP:
                            best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (score, asked, answered))
        for (r, item), values in sorted(best.items()):
            yield r, self.ids[item], *values


def shards(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Shard]:
    """The index of all items with words, in shards."""
    given = [(r[0], r[1]) for r in items.select(F.col(item_id).cast("bigint"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator()]
    given = sorted(((i, t) for i, t in given if len(hashed(t))), key=lambda x: (len(hashed(x[1])), -(2**63) if x[0] is None else x[0]))
    frequency: Counter = Counter()
    words = 0
    for _, t in given:
        h = hashed(t)
        words += len(h)
        frequency.update(set(h.tolist()))
    weight = {t: math.log(1 + (len(given) - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
    return [Shard(given[k : k + SHARD], weight, words / len(given)) for k in range(0, len(given), SHARD)]


def _found(texts: pa.Array, index: list[Shard]) -> list[tuple[int, int, float, float, float]]:
    """Matches of a batch's rows with the items of some shards."""
    data, offsets = text_buffer(texts)
    out = []
    for begin, end in slices(offsets, 1_000_000):
        part = offsets[begin : end + 1]
        lower = PLAIN[data[part[0] : part[-1]]]
        starts, ends, row = word_spans(lower, part - part[0])
        h = word_hashes(lower, starts, ends)
        first = np.searchsorted(row, np.arange(end - begin + 1))
        for shard in index:
            out += [(begin + m[0], *m[1:]) for m in shard.matches(h, first)]
    return out


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every document that holds a test item."""
    spark, index = docs.sparkSession, shards(items)
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def one_pass(shared) -> DataFrame:
        def walk(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(given):
                if found := _found(batch.column(1), shared.value):
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(walk, schema)

    passes = [one_pass(spark.sparkContext.broadcast(index[k : k + GROUP])) for k in range(0, len(index), GROUP)]
    if not passes:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    return reduce(DataFrame.unionAll, passes).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    spark, index, at = docs.sparkSession, shards(items), docs.columns.index(text)
    kept = docs
    for k in range(0, len(index), GROUP):
        shared = spark.sparkContext.broadcast(index[k : k + GROUP])

        def walk(given: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(given):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in _found(batch.column(at), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(walk, docs.schema)
    return kept
