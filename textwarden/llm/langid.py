"""Language identification by error-correcting output codes.

Every language has a codeword of bits; a binary classifier over hashed byte n-grams predicts each bit. A document's
language is the codeword with the least loss against all predicted margins (loss-weighted decoding); the margin over
the second-best codeword gives the score and flags ambiguity.

The classifiers are fitted in numpy on a bounded sample of the labelled training rows: about sample_rows in all, the
same number for each language, at least one, those with the least hashes of their identifiers. Fitting runs in one
executor task on sparse rows in small batches; the driver only gets the model. Every label is learned, however many
there are, and every document is scored on its whole text.

Cases: null texts and texts without a letter are `und` with score 0; languages are learned from the labels, null labels
train nothing; with one language, or none, every text with a letter gets it, or `und`; null identifiers are neither
held out nor trained on; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import crc_mod

BITS = 13
DIM = 1 << BITS
#: Bound of the training sample, over all languages.
SAMPLE_ROWS = 6000
#: Rows that are dense at once.
BATCH = 128
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Texts are read in pieces of this size, so that a text of any length takes bounded memory.
PIECE = 1 << 20


def has_letter(text: str) -> bool:
    return LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """Hashed counts of the text's byte 1- to 4-grams; ASCII upper case counts as lower."""
    raw = b" " + text.encode().lower() + b" "
    out = np.zeros(DIM, np.float32)
    for at in range(0, len(raw), PIECE):
        x = np.frombuffer(raw[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        for n in (1, 2, 3, 4):
            if len(x) >= n:
                h = np.full(len(x) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h * np.uint32(0x01000193)) ^ x[k : len(x) - n + 1 + k]
                h *= np.uint32(0x9E3779B1)
                out += np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)[:DIM]
    return out


def features(rows: np.ndarray) -> np.ndarray:
    """Square roots of counts at unit length."""
    x = np.sqrt(rows)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """(classes, bits) of -1 and 1, all different: random bits chosen for distance, behind one bit per class for few classes."""
    few = classes <= 32
    length = max(4, int(np.ceil((2 if few else 12) * np.log2(max(classes, 2)))) + 2)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (classes, length))
        m = m[:, np.abs(m.sum(axis=0, dtype=int)) < classes] if classes > 1 else m
        if not few and len(np.unique(m, axis=0)) < classes:
            continue
        near = m[:40].astype(int)
        d = int((near.shape[1] - near @ near.T + 2 * near.shape[1] * np.eye(len(near), dtype=int)).min()) // 2
        if d > far:
            best, far = m, d
    return np.concatenate([2 * np.eye(classes, dtype=np.int8) - 1, best], axis=1) if few else best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, score) per row of features: losses log(1 + exp(-code * margin)), weighted by each bit's trust."""
        margins = x @ self.weights + self.bias
        one = (self.code > 0).T.astype(np.float32)
        loss = (np.logaddexp(0, -margins) * self.trust) @ one + (np.logaddexp(0, margins) * self.trust) @ (1 - one)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, p[np.arange(len(p)), best]


class Rows:
    """Sparse rows of counts: places and numbers."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    @staticmethod
    def pack(row: np.ndarray) -> bytes:
        at = np.flatnonzero(row)
        return at.astype("<u2").tobytes() + row[at].astype("<u4").tobytes()

    def dense(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), DIM), np.float32)
        for i, k in enumerate(which.tolist()):
            raw = self.packed[k]
            n = len(raw) // 6
            out[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<u4", n, 2 * n)
        return features(out)


def fit(rows: Rows, y: np.ndarray, languages: list[str], epochs: int = 8, rate: float = 8.0, decay: float = 1e-5, seed: int = 3) -> Model:
    """Logistic regressions of all bits at once, by steps over small batches with momentum and a falling rate."""
    code = codewords(len(languages))
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * share[y])).astype(np.float32)
    weights, bias = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, lift = np.zeros_like(weights), np.zeros_like(bias)
    rng, right = np.random.default_rng(seed), np.zeros(code.shape[1])
    for epoch in range(epochs + 1):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            which = order[at : at + BATCH]
            x, goal = rows.dense(which), code[y[which]].astype(np.float32)
            margin = goal * (x @ weights + bias)
            if epoch == epochs:  # the last round measures how far each bit can be trusted
                right += (margin > 0).sum(axis=0)
                continue
            step = rate / (1 + epoch)
            pull = -goal / (1 + np.exp(np.clip(margin, -30, 30))) * weight[which][:, None] / len(which)
            speed = 0.9 * speed - 0.1 * step * (x.T @ pull + decay * weights)
            lift = 0.9 * lift - 0.1 * step * pull.sum(axis=0)
            weights, bias = weights + speed, bias + lift
    return Model(languages, code, weights, bias, np.clip(2 * right / max(1, len(y)) - 1, 0.01, 1).astype(np.float32))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [Rows.pack(counts(t)) if has_letter(t) else None for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the sample to one row with the model."""
    if not (held := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("x", "ascending")])
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {v: i for i, v in enumerate(languages)}
    model = fit(Rows(table.column("x").to_pylist()), np.array([number[v] for v in names]), languages)
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def train(docs: DataFrame, folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the rows whose crc32 of the identifier modulo folds isn't held."""
    rows = docs.where((crc_mod("doc_id", folds) != held) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("lang", "_lang")
    languages = sizes.count()
    if not languages:
        return None
    # About as many rows of each language: those whose hash is below a share of all hashes, one at least.
    share = F.lit(1.2 * sample_rows / languages) / F.col("_n")
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    first = rows.groupBy("lang").agg(F.min(F.xxhash64("doc_id")).alias("_first")).withColumnRenamed("lang", "_lang")
    bounds = sizes.join(first, "_lang").select("_lang", share.alias("_share"), "_first")
    picked = rows.join(F.broadcast(bounds) if languages <= 1_000_000 else bounds, F.col("lang") == F.col("_lang")).where((dice < F.col("_share")) | (F.xxhash64("doc_id") == F.col("_first"))).select("doc_id", "lang", "text")
    sample = picked.mapInArrow(_counted, "doc_id long, lang string, x binary").where("x IS NOT NULL")
    found = sample.repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def predict(docs: DataFrame, model: Model | None, folds: int = 4, held: int = 2, ambiguous_below: float = 0.6) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(2).to_pylist()
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                live = [i for i, t in enumerate(texts) if t and has_letter(t)] if m else []
                if live:
                    best, sure = m.decode(features(np.stack([counts(texts[i]) for i in live])))
                    for i, k, s in zip(live, best, sure, strict=True):
                        lang[i], score[i] = m.languages[k], float(s)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s < ambiguous_below for s in score])], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return predict(docs, train(docs, folds, held, sample_rows), folds, held)
