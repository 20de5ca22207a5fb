"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then an overlap check.

The test items form a small inverted index whose impacts are BM25 weights divided by the item's score for its own text,
so that a passage that holds a whole item scores 1. Postings are cut into blocks of items; a block keeps its largest
impact. Every passage of every document (windows that overlap by half, long enough to hold any item whole) is a query:
the terms' largest impacts skip windows that can't reach the threshold, the block maxima skip blocks of items, and the
items of the blocks left are scored in full. All items at or above the threshold are retrieved, not a top few. The bounds
are those of block-max WAND; its cursors and pivots are replaced by adding up the maxima of all blocks of a window at
once, since 94 % of the windows of ordinary text reach the threshold by their terms' bounds alone, and moving cursors one
by one in Python costs many times what the sums cost.

A retrieved item counts as leaked if the document holds at least overlap of the 5-word shingles of its question and of
its answer. Items without a separate answer are split: the last quarter of the words, five at least, is the answer
(items of fewer than ten words are both at once; parts of fewer than five words are one shingle). So short an answer is
lost by one changed word; split items therefore leak too if the document holds overlap of the shingles of the whole
item, or, where one changed word breaks more than that, all word pairs but one word's (or overlap of them) in a stretch
of the document twice as long as the item.

The index goes to executors in blocks of MAX_ITEMS items and MAX_ITEM_WORDS words at most, a pass over the documents
for each, so what is broadcast stays bounded.

Cases: null and empty texts hold nothing; null or wordless items leak nowhere; repeated items each give a row; repeated
documents give a row each; words are lower-cased and end at blanks and ASCII marks; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.8
ITEM_BLOCK = 16
MAX_ITEMS, MAX_ITEM_WORDS = 20_000, 4_000_000
_TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TABLE).split()


def shingles(line: list[bytes]) -> set[tuple]:
    return {tuple(line[i : i + WORDS]) for i in range(max(1, len(line) - WORDS + 1))} if line else set()


def parts(line: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item that has one text."""
    if len(line) < 2 * WORDS:
        return line, line
    cut = len(line) - max(WORDS, math.ceil(len(line) / 4))
    return line[:cut], line[cut:]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Index:
    """items: (item_id, question words, answer words), none empty; split says that both come from one text."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], threshold: float = THRESHOLD, split: bool = False):
        self.threshold, self.split = threshold, split
        self.ids = [i for i, _, _ in items]
        self.parts = [(shingles(q), shingles(a)) for _, q, a in items]
        lines = self.lines = [q if q == a else q + a for _, q, a in items]
        self.window = max(128, 2 * max(map(len, lines)))
        self.number = _Numbers()
        rows: dict[int, dict[int, int]] = {}
        for k, line in enumerate(lines):
            for w in line:
                n = self.number.setdefault(w, len(self.number) + 1)
                rows.setdefault(n, {})
                rows[n][k] = rows[n].get(k, 0) + 1
        mean = sum(map(len, lines)) / len(lines)
        own = np.zeros(len(lines))
        impact: dict[int, list[tuple[int, float]]] = {}
        for n, tf in rows.items():
            idf = math.log(1 + (len(lines) - len(tf) + 0.5) / (len(tf) + 0.5))
            impact[n] = [(k, idf * c * (K1 + 1) / (c + K1 * (1 - B + B * len(lines[k]) / mean))) for k, c in sorted(tf.items())]
            for k, x in impact[n]:
                own[k] += x
        # Postings, and under them blocks with their largest impact, both as rows that begin at starts.
        flat = [(n, k, x / own[k]) for n in sorted(impact) for k, x in impact[n]]
        self.item = np.array([k for _, k, _ in flat])
        self.weight = np.array([x for _, _, x in flat])
        term = np.array([n for n, _, _ in flat])
        self.start = np.searchsorted(term, np.arange(len(self.number) + 2))
        key = term * (len(lines) // ITEM_BLOCK + 1) + self.item // ITEM_BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.block = self.item[first] // ITEM_BLOCK
        self.block_max = np.maximum.reduceat(self.weight, first)
        self.block_start = np.searchsorted(term[first], np.arange(len(self.number) + 2))
        self.upper = np.zeros(len(self.number) + 1)
        np.maximum.at(self.upper, term, self.weight)

    @staticmethod
    def _rows(terms: np.ndarray, start: np.ndarray) -> np.ndarray:
        size = start[terms + 1] - start[terms]
        return np.repeat(start[terms] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())

    def retrieve(self, codes: np.ndarray) -> dict[int, float]:
        """Items at or above the threshold in some window of a document: best score of each."""
        n, half, found = len(codes), self.window // 2, {}
        most = np.concatenate([[0.0], np.cumsum(self.upper[codes])])
        starts = np.arange(0, max(1, n - half), half)
        ends = np.minimum(starts + self.window, n)
        slack = self.threshold - 1e-9
        for s, e in zip(starts[most[ends] - most[starts] >= slack], ends[most[ends] - most[starts] >= slack], strict=True):
            terms = np.unique(codes[s:e])
            terms = terms[terms > 0]
            if self.upper[terms].sum() < slack:
                continue
            at = self._rows(terms, self.block_start)
            live = np.bincount(self.block[at], self.block_max[at]) >= slack
            if not live.any():
                continue
            at = self._rows(terms, self.start)
            at = at[live[self.item[at] // ITEM_BLOCK]]
            score = np.bincount(self.item[at], self.weight[at])
            for k in np.flatnonzero(score >= slack):
                found[int(k)] = max(found.get(int(k), 0.0), float(score[k]))
        return found

    def leaks(self, text: str | None, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of the items that the text holds."""
        line = words(text)
        if not line:
            return []
        found = self.retrieve(np.fromiter(map(self.number.__getitem__, line), np.int64, len(line)))
        if not found:
            return []
        sizes = {len(s) for k in found for p in self.parts[k] for s in p}
        held = {tuple(line[i : i + n]) for n in sizes for i in range(len(line) - n + 1)}
        out = []
        for k, score in sorted(found.items()):
            share = [sum(s in held for s in p) / len(p) for p in self.parts[k]]
            if min(share) >= overlap or (self.split and self._whole(line, held, k, overlap)):
                out.append((self.ids[k], score, *share))
        return out

    def _whole(self, line: list[bytes], held: set[tuple], k: int, overlap: float) -> bool:
        """Whether a text holds a split item as a whole, up to a few words."""
        item = self.lines[k]
        if len(item) < 2 * WORDS:
            return False
        whole = shingles(item)
        if sum(s in held for s in whole) >= overlap * len(whole):
            return True
        if len(whole) - WORDS >= overlap * len(whole):
            return False
        pairs = set(zip(item, item[1:], strict=False))
        least = min(overlap * len(pairs), len(pairs) - 2)
        at = [(i, p) for i, p in enumerate(zip(line, line[1:], strict=False)) if p in pairs]
        inside: dict[tuple, int] = {}
        first = 0
        for i, p in at:
            inside[p] = inside.get(p, 0) + 1
            while at[first][0] <= i - 2 * len(item):
                old = at[first][1]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                first += 1
            if len(inside) >= least:
                return True
        return False


def item_blocks(items: DataFrame, id_col: str, question_col: str, answer_col: str | None) -> Iterator[list]:
    """The items in bounded lists, read one partition at a time."""
    chosen = items.select(F.col(id_col).cast("long"), question_col, *([answer_col] if answer_col else []))
    block, size = [], 0
    for row in chosen.toLocalIterator():
        q, a = (words(row[1]), words(row[2])) if answer_col else parts(words(row[1]))
        q, a = q or a, a or q
        if row[0] is None or not q:
            continue
        block.append((row[0], q, a))
        size += len(q) + len(a)
        if len(block) >= MAX_ITEMS or size >= MAX_ITEM_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", question: str = "text", answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item that it holds."""
    spark = docs.sparkSession
    passes = []
    for block in item_blocks(items, item_id, question, answer):
        sent = spark.sparkContext.broadcast(Index(block, threshold, split=answer is None))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in sent.value.leaks(t, overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        passes.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA))
    out = passes[0] if passes else spark.createDataFrame([], SCHEMA)
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", question: str = "text", answer: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever their identifiers."""
    for block in item_blocks(items, item_id, question, answer):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, split=answer is None))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, place: int = docs.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.leaks(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
