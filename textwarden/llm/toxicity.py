"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's input is a learned vector of its word joined with the mean vector of its hashed character n-grams. Windows of
32 tokens that overlap by half cover the whole text; two recurrent passes read each, attention weighs their states, and
a document's score is that of its worst window.

Training takes a bounded sample of the labelled rows and runs in one executor task; the driver only gets the network.
Labels hold for documents, not windows, so training first picks the window of each toxic document that has the most
telling features, then alternates: fit, and pick again the worst window of each document by the network itself (which
also finds the clean windows it gets wrong). Last, all labelled rows that aren't held out are rated on the executors, and
the threshold is moved to where they are told apart best, in the ratio in which they come.

Cases: null and empty texts are one window of padding with a score of their own; null identifiers are neither held out
nor trained on; repeated rows are scored each, and of rows with one identifier the least text trains; labels that are null, or whose document is missing, train nothing;
without labels of both kinds the score is the share of toxic labels (0 without any); an empty table gives an empty
result; a text of any length is scored in slices of whole windows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textwarden.llm.common import crc_mod, released, written

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 12
CHAR_BITS, WORD_ROWS = 15, 8192
#: Bounds of the training sample.
TOXIC_ROWS, CLEAN_ROWS = 1200, 2500
CACHE = 100_000
SLICE = 4096
#: Logits are counted in bins of 1 / BINS up to FAR either way.
BINS, FAR = 64, 60
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Longer words are cut at blanks of any kind and ASCII marks, then into pieces that share so many bytes.
LONG, SHARED = 60, 6
INNER = re.compile(r"[\s!-/:-@\[-`{-~]+")


def pieces(word: bytes) -> list[bytes]:
    """A word of any length as words of at most LONG bytes; every 7-gram of what stands between marks is in one."""
    if len(word) <= LONG:
        return [word]
    parts = [w.encode() for w in INNER.split(word.decode())]
    return [w[i : i + LONG] for w in parts for i in range(0, max(1, len(w) - SHARED), LONG - SHARED)]


def tokens(text: str | None) -> list[bytes]:
    """The text's words in lower case without marks around them, long ones in pieces."""
    words = [w.strip(MARKS) for w in (text or "").encode().lower().split()]
    if max(map(len, words), default=0) > LONG:
        words = [p for w in words for p in pieces(w)]
    return [w for w in words if w]


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): each word's hashed byte 3-, 5- and 7-grams and its beginnings of 4, 6, 8 and 9 bytes, marks
    around the word included, and where each word's begin."""
    raw = b"".join(b"\x02" + w + b"\x03" for w in words)
    size = np.array([len(w) + 2 for w in words])
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    out, of = [], []
    for n in (3, 5, 7, 4, 6, 8, 9):
        if n in (3, 5, 7):
            inside = np.flatnonzero(word[n - 1 :] == word[: max(0, len(x) - n + 1)])
        else:
            inside = begin[size >= n]
        h = np.full(len(inside), n, np.uint32)
        for k in range(n):
            h = (h * np.uint32(0x01000193)) ^ x[inside + k]
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS))
        of.append(word[inside])
    h = np.full(len(words), 0, np.uint32)  # a bucket for the first byte, so that no word is without one
    out.append(((h + x[begin + 1]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS))
    of.append(np.arange(len(words)))
    buckets, owner = np.concatenate(out), np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return buckets[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def windows(length: int) -> np.ndarray:
    """Starts of the windows over a text of so many tokens; the last one ends with it."""
    if length <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, length - WINDOW, STRIDE), length - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _sum_rows(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by index."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        line = index[order]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        out[line[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Net:
    """p: parameters by name. Directions are stacked on a leading axis of two."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 5):
        rng = np.random.default_rng(seed)
        near = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.vocabulary, self.offset = vocabulary, 0.0
        self.p = {
            "word": np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32), "char": near(1 << CHAR_BITS, CHAR_DIM, k=0.05),
            "wx": near(2, WORD_DIM + CHAR_DIM, 3 * HIDDEN), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32), "wh": near(2, HIDDEN, 3 * HIDDEN),
            "att": near(2 * HIDDEN), "out": near(2 * HIDDEN), "b": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words."""
        buckets, starts = char_grams(words)
        number = np.diff(np.append(starts, len(buckets)))[:, None]
        chars = np.add.reduceat(self.p["char"][buckets], starts, axis=0) / np.sqrt(number)
        at = np.array([self.vocabulary.get(w, 0) for w in words])
        return np.concatenate([self.p["word"][at], chars], axis=1).astype(np.float32), (buckets, starts, number, at)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3H): input parts of the gates; the last row is padding, which keeps the state."""
        g = x @ self.p["wx"] + self.p["bx"]
        pad = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        pad[:, :, :HIDDEN] = 30.0
        return np.concatenate([g, pad], axis=1)

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows (index into gates, -1 is padding)."""
        n, length = index.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, length, n, HIDDEN), np.float32)
        trace = []
        for t in range(length):
            s = length - 1 - t
            g = np.stack([gates[0][index[:, t]], gates[1][index[:, s]]])
            u = h @ self.p["wh"]
            zr = _sigmoid(g[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            c = np.tanh(g[:, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
            new = c + z * (h - c)
            if keep:
                trace.append((h, z, r, c, u[:, :, 2 * HIDDEN :]))
            h = new
            states[0, t], states[1, s] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2)
        e = both @ self.p["att"]
        e[index.T < 0] = -1e4
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * both).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["b"]
        return (logit, (trace, both, a, pooled)) if keep else logit

    def backward(self, gates: np.ndarray, index: np.ndarray, kept: tuple, d_logit: np.ndarray, x: np.ndarray, made: tuple) -> dict[str, np.ndarray]:
        trace, both, a, pooled = kept
        n, length = index.shape
        p, d = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        d["b"][0] = d_logit.sum()
        d["out"] = pooled.T @ d_logit
        d_pool = d_logit[:, None] * p["out"]
        d_a = (both * d_pool).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        d["att"] = np.tensordot(d_e, both, axes=([0, 1], [0, 1]))
        d_both = a[:, :, None] * d_pool + d_e[:, :, None] * p["att"]
        steps, carry = np.empty((2, length, n, 3 * HIDDEN), gates.dtype), np.zeros((2, n, HIDDEN), np.float32)
        for t in reversed(range(length)):
            s = length - 1 - t
            h, z, r, c, u = trace[t]
            dh = carry + np.stack([d_both[t][:, :HIDDEN], d_both[s][:, HIDDEN:]])
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            d["wh"] += np.swapaxes(h, 1, 2) @ du
            carry = dh * z + du @ np.swapaxes(p["wh"], 1, 2)
            steps[0, t], steps[1, s] = dg[0], dg[1]
        where = np.where(index.T < 0, len(x), index.T).ravel()
        dg = np.stack([_sum_rows(where, steps[k].reshape(-1, 3 * HIDDEN), len(x) + 1)[:-1] for k in (0, 1)])
        d["wx"] = x.T @ dg
        d["bx"] = dg.sum(axis=1, keepdims=True)
        dx = (dg @ np.swapaxes(p["wx"], 1, 2)).sum(axis=0)
        buckets, starts, number, at = made
        d["word"] = _sum_rows(at, dx[:, :WORD_DIM], len(d["word"]))
        d["word"][0] = 0
        per = np.repeat(dx[:, WORD_DIM:] / np.sqrt(number), number[:, 0], axis=0)
        d["char"] = _sum_rows(buckets, per, len(d["char"]))
        return d


class Scorer:
    """Scores texts with a trained network; gate inputs of words are computed once in a task."""

    def __init__(self, net: Net):
        self.net, self.rows = net, {}
        self.table = net.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))

    def _know(self, words: list[bytes]) -> None:
        fresh = list({w for w in words if w not in self.rows})
        if not fresh:
            return
        if len(self.rows) + len(fresh) > CACHE:
            self.rows, self.table = {}, self.table[:, -1:]
            fresh = list(set(words))
        x, _ = self.net.inputs(fresh)
        first = self.table.shape[1] - 1
        self.table = np.concatenate([self.table[:, :-1], self.net.gates(x)], axis=1)
        self.rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def windows_of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(logits of all windows, owner of each)."""
        flat = [w for t in texts for w in t]
        self._know(flat)
        ids = np.fromiter(map(self.rows.__getitem__, flat), np.int64, len(flat))
        ids = np.concatenate([ids, np.full(WINDOW, -1)])
        index, owner, at = [], [], 0
        for k, t in enumerate(texts):
            start = windows(len(t))
            rows = ids[at + start[:, None] + np.arange(WINDOW)]
            if len(t) < WINDOW:
                rows[:, len(t) :] = -1
            index.append(rows)
            owner.append(np.full(len(start), k))
            at += len(t)
        index = np.concatenate(index)
        logits = [self.net.forward(self.table, index[i : i + SLICE]) for i in range(0, len(index), SLICE)]
        return np.concatenate(logits), np.concatenate(owner)

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Worst window of each text. Long texts are cut into overlapping slices of whole windows."""
        parts, owner = [], []
        step = 64 * WINDOW * STRIDE
        for k, t in enumerate(texts):
            for i in range(0, max(1, len(t) - WINDOW + STRIDE), step):
                parts.append(t[i : i + step + WINDOW])
                owner.append(k)
        out = np.full(len(texts), -np.inf)
        group, size, first = [], 0, 0
        for i, part in enumerate([*parts, None]):
            if part is None or size > 60_000:
                if group:
                    logit, of = self.windows_of(group)
                    np.maximum.at(out, np.array(owner)[first + of], logit)
                group, size, first = [], 0, i
            if part is not None:
                group.append(part)
                size += len(part)
        return out

def _telling(docs: list[list[bytes]], toxic: np.ndarray) -> dict[bytes, float]:
    """How much more often each word, or any word with its rarest n-grams, stands in toxic documents."""
    buckets = 1 << CHAR_BITS
    grams: dict[bytes, np.ndarray] = {}
    seen = np.zeros((2, buckets))
    words: dict[bytes, list[int]] = {}
    for doc, label in zip(docs, toxic, strict=True):
        own = list(set(doc))
        fresh = [w for w in own if w not in grams]
        if fresh:
            b, s = char_grams(fresh)
            grams.update(zip(fresh, np.split(b, s[1:]), strict=True))
        if own:
            seen[int(label), np.unique(np.concatenate([grams[w] for w in own]))] += 1
        for w in own:
            words.setdefault(w, [0, 0])[int(label)] += 1
    n = np.array([max(1, (toxic == 0).sum()), max(1, toxic.sum())])
    odds = lambda c, t: np.where(t >= 3, np.log((t + 0.5) / n[1]) - np.log((c + 0.5) / n[0]), 0.0)
    of = odds(seen[0], seen[1])
    return {w: float(max(of[grams[w]].max(initial=0), odds(np.array(c), np.array(t)))) for w, (c, t) in words.items()}


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 3, steps: int = 120, batch: int = 256, seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    pool: dict[bytes, bytes] = {}
    docs = [[pool.setdefault(w, w) for w in tokens(t)] for t in texts]  # one object a distinct word
    often: dict[bytes, int] = {}
    for d in docs:
        for w in set(d):
            often[w] = often.get(w, 0) + 1
    kept = sorted((w for w, n in often.items() if n >= 3), key=lambda w: (-often[w], w))[:WORD_ROWS]
    net = Net({w: i + 1 for i, w in enumerate(kept)}, seed)
    sign = _telling(docs, toxic)

    def cut(d: list[bytes], start: int) -> list[bytes]:
        return d[start : start + WINDOW]

    def best(d: list[bytes]) -> list[bytes]:
        marks = np.array([sign[w] for w in d] or [0.0])
        return cut(d, max(windows(len(d)).tolist(), key=lambda s: (marks[s : s + WINDOW].max(initial=0), marks[s : s + WINDOW].sum())))

    bad = [best(d) for d, y in zip(docs, toxic, strict=True) if y]
    clean_docs = [d for d, y in zip(docs, toxic, strict=True) if not y]
    clean = [cut(d, int(rng.choice(windows(len(d))))) for d in clean_docs for _ in range(2)] + [best(d) for d in clean_docs]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    tick = 0
    for r in range(rounds):
        if r:
            logit, owner = [], []
            scorer = Scorer(net)
            for i in range(0, len(docs), 200):
                x, of = scorer.windows_of(docs[i : i + 200])
                logit.append(x)
                owner.append(of + i)
            logit, owner = np.concatenate(logit), np.concatenate(owner)
            start = np.searchsorted(owner, np.arange(len(docs)))
            worst = [int(logit[a:b].argmax()) for a, b in zip(start, np.append(start[1:], len(owner)), strict=True)]
            picked = [cut(d, int(windows(len(d))[w])) for d, w in zip(docs, worst, strict=True)]
            bad = [x for x, y in zip(picked, toxic, strict=True) if y]
            clean += [x for x, y in zip(picked, toxic, strict=True) if not y]
        for _ in range(steps):
            half = batch // 2
            rows = [bad[i] for i in rng.integers(len(bad), size=half)] + [clean[i] for i in rng.integers(len(clean), size=half)]
            own = sorted({w for row in rows for w in row}) or [b""]
            number = {w: i for i, w in enumerate(own)}
            index = np.full((len(rows), WINDOW), -1)
            for i, row in enumerate(rows):
                index[i, : len(row)] = [number[w] for w in row]
            goal = np.repeat([1.0, 0.0], half).astype(np.float32)
            x, made = net.inputs(own)
            gates = net.gates(x)
            logit, kept_states = net.forward(gates, index, keep=True)
            d_logit = ((_sigmoid(logit) - goal) / len(rows)).astype(np.float32)
            grads = net.backward(gates, index, kept_states, d_logit, x, made)
            tick += 1
            for k, g in grads.items():
                if k in ("word", "char"):  # plain steps: vectors that are seen rarely stay near their start
                    net.p[k] -= 3.0 * g + 1e-4 * net.p[k]
                    continue
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.p[k] -= 0.01 * (first[k] / (1 - 0.9**tick)) / (np.sqrt(second[k] / (1 - 0.999**tick)) + 1e-7)
    return net


def _divide(bins: np.ndarray, toxic: np.ndarray, number: np.ndarray) -> float:
    """The logit that tells the documents apart with the best F1, in the middle between the bins beside it."""
    values, at = np.unique(-bins, return_inverse=True)
    hits = np.cumsum(np.bincount(at, number * toxic))
    f1 = 2 * hits / (np.cumsum(np.bincount(at, number)) + hits[-1])
    cut = int(f1.argmax())
    low = 1 - values[cut + 1] if cut + 1 < len(values) else -values[cut] - 2 * BINS
    return float((low - values[cut]) / 2 / BINS)


def rated(docs: DataFrame, net: Net, text_col: str = "text", out: str = "_logit") -> DataFrame:
    """docs with the logit of each row's worst window in a column out, before the threshold is taken off."""
    sent, place = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = scorer.logits([tokens(t) for t in batch.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x.astype(np.float64))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def threshold(logits: DataFrame, rows: DataFrame, out: str = "_logit") -> float:
    """The logit to cut at, from the rated documents of all labelled rows (doc_id, toxic)."""
    told = logits.select("doc_id", F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col(out))) * F.lit(BINS)).alias("bin")).join(rows, "doc_id")
    bins = told.groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * 2 * FAR * BINS at most
    return _divide(*np.array([(r.bin, r.toxic, r.n) for r in bins], np.int64).T)


def _gold(labels: DataFrame, folds: int, held: int) -> DataFrame:
    """(doc_id, toxic) of the labelled rows that aren't held out."""
    return labels.where((crc_mod("doc_id", folds) != held) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))


def _fit(docs: DataFrame, rows: DataFrame, toxic_rows: int, clean_rows: int) -> Net | float:
    """A network without its threshold; the share of toxic labels where only one kind exists."""
    dice = F.xxhash64(F.col("doc_id"), F.lit(11))
    few = [rows.where(F.col("toxic") == k).orderBy(dice, "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    picked = F.broadcast(few[0].unionByName(few[1]))  # at most toxic_rows + clean_rows rows
    sample = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    found = sample.repartition(1).mapInArrow(_fitted, "net binary").collect()
    return pickle.loads(found[0].net) if found else 0.0


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Net | float:
    """A network from the labelled rows that aren't held out; the share of toxic labels where only one kind exists."""
    rows = _gold(labels, folds, held)
    net = _fit(docs, rows, toxic_rows, clean_rows)
    if isinstance(net, Net):
        net.offset = -threshold(rated(docs.select("doc_id", "text").join(rows.select("doc_id"), "doc_id", "left_semi"), net), rows)
    return net


@released
def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the sample to one row with the network, or the share of toxic labels."""
    if not (held := [b for b in batches if b.num_rows]):
        return
    sample = pa.Table.from_batches(held).sort_by("doc_id")
    y = sample.column("toxic").to_numpy().astype(np.int64)
    net = float(y.mean()) if y.min() == y.max() else fit(sample.column("text").to_pylist(), y)
    yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})


def _with_scores(docs: DataFrame, logit: Column | None, share: float, folds: int, held: int) -> DataFrame:
    score = F.lit(share) if logit is None else F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, net: Net | float, folds: int = 5, held: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    if not isinstance(net, Net):
        return _with_scores(docs, None, net, folds, held)
    return _with_scores(rated(docs.select("doc_id", "text"), net), F.col("_logit") + F.lit(net.offset), 0.0, folds, held)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """score() by a network that is trained on the labels; every document is rated once, for the threshold and its score."""
    rows = _gold(labels, folds, held)
    net = _fit(docs, rows, TOXIC_ROWS, CLEAN_ROWS)
    if not isinstance(net, Net):
        return _with_scores(docs, None, net, folds, held)
    logits = written(rated(docs.select("doc_id", "text"), net).drop("text"), "toxicity-logits")
    return _with_scores(logits, F.col("_logit") - F.lit(threshold(logits, rows)), 0.0, folds, held)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't call toxic, with all their columns."""
    rows = _gold(labels, 5, 0)
    net = _fit(docs, rows, TOXIC_ROWS, CLEAN_ROWS)
    if not isinstance(net, Net):
        return docs.where(F.lit(net < 0.5))
    scored = written(rated(docs, net, out="_toxicity_logit"), "toxicity-rated")
    return scored.where(F.col("_toxicity_logit") < F.lit(threshold(scored, rows, "_toxicity_logit"))).drop("_toxicity_logit")
