"""Language-model scores by prediction by partial matching over bytes.

A text is its words in lower case, each with a closing blank, then an end byte. The model is a trie of byte contexts of
up to ORDER bytes that run across blanks, counted over all training texts. A byte is predicted by its longest context
that was ever seen; from there escapes lead to the next shorter one down to the empty context and at last to a uniform
choice. At every step the symbols seen in the longer context are excluded: a context with n occurrences of q symbols
that aren't excluded gives a symbol of count c the share (2c - 1) / 2n and the escape q / 2n.

1. Documents are cut into blocks, kept as word numbers in a file of the block in the shared folder. A block reports its
   distinct (context, byte) grams and words with their training counts, dealt out to buckets: grams by their last three
   context bytes, so a bucket holds whole subtrees, words by a hash.
2. A bucket adds up the counts of all blocks, builds its part of the trie, and sends the code length of each gram and the
   count of each word back to the blocks that asked. Contexts of up to two bytes are shared by all buckets: their counts
   (2**24 at most, in real texts some 100,000) are broadcast.
3. A task for each block adds up the code lengths of its documents.

So what is gathered grows with the input and is never in one place, and texts are never shuffled.

Cases: null text is empty and holds the end token only; a byte that was never seen has a finite code length; null
identifiers belong neither to the training nor to the held-out rows; repeated rows count and score each for itself;
without any training row all counts are zero and every byte costs log10(256); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import open_fs, shared_dir, write_atomically, written

ORDER, SHARED_ORDER = 5, 2
#: Bounds of a block: tokens, distinct words and documents; and bytes that are looked at in one go.
BLOCK_TOKENS, BLOCK_WORDS, BLOCK_DOCS, SLICE = 8_000_000, 600_000, 500_000, 4_000_000
MOST_BUCKETS = 1 << 16
BLANK, END = 0x20, 0x0A
FOLDS, HELD = 5, 1
BYTE, PAIR = np.int64(8), np.int64(16)


def fold_of(doc_id: int | None, folds: int = FOLDS) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def squeezed(x: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """An array, its elements' first bytes first, compressed."""
    x = np.ascontiguousarray(x)
    return squeeze.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) if len(x) else b""


def expanded(raw: bytes, kind: str, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(expand.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1) if raw else np.empty(0, kind)


# Grams: a context's bytes, the last one first, and the byte behind it.


def grams(texts: list[bytes]) -> np.ndarray:
    """The grams of all bytes of some texts, as if each began behind ORDER ends."""
    pad = bytes([END]) * ORDER
    x = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    n = len(x) - ORDER
    if n <= 0:
        return np.empty(0, np.int64)
    key = x[ORDER - 1 : ORDER - 1 + n].copy()
    for back in range(2, ORDER + 1):
        key = key << BYTE | x[ORDER - back : ORDER - back + n]
    key = key << BYTE | x[ORDER:]
    size = np.array([len(t) for t in texts])
    return key[np.repeat(np.cumsum(size + ORDER) - size - ORDER - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def counted(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all texts and how often each occurs in the training texts."""
    keys, counts, part, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], 0
    for i, text in enumerate(texts):
        part.append(i)
        size += len(text)
        if size > SLICE or i + 1 == len(texts):
            for flag in (True, False):
                if chosen := [texts[k] for k in part if train[k] == flag]:
                    key, n = np.unique(grams(chosen), return_counts=True)
                    keys.append(key)
                    counts.append(n if flag else np.zeros(len(key), np.int64))
            part, size = [], 0
            if len(keys) > 8:
                key, n = added(keys, counts)
                keys, counts = [key], [n]
    return added(keys, counts)


def shorter(key: np.ndarray, n: np.ndarray, steps: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Grams with their contexts' first bytes left out."""
    return added([key >> np.int64(8 * (steps + 1)) << BYTE | key & 255], [n])


class Level:
    """The contexts of one length: grams with counts, and each context's occurrences and number of symbols."""

    def __init__(self, key: np.ndarray, n: np.ndarray, below: Level | None):
        self.key, self.n = key, n
        self.context, start = np.unique(key >> BYTE, return_index=True)
        self.total = np.add.reduceat(n, start) if len(n) else n
        self.symbols = np.diff(np.append(start, len(key)))
        #: How often the context without its first byte is followed by one of this context's symbols.
        self.excluded = np.zeros(len(start), np.int64)
        if below is not None and len(key):
            self.excluded = np.add.reduceat(below.n[np.searchsorted(below.key, key >> PAIR << BYTE | key & 255)], start)


def levels(key: np.ndarray, n: np.ndarray, order: int, below: list[Level]) -> list[Level]:
    """The levels of orders len(below) to order from the counts of the longest grams, behind those below."""
    grown = [(key, n)]
    while len(grown) <= order - len(below):
        grown.append(shorter(*grown[-1]))
    out = list(below)
    for key, n in reversed(grown):
        out.append(Level(key, n, out[-1] if out else None))
    return out


def _found(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return at, sorted_keys[at] == key


def code_lengths(model: list[Level], key: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams whose contexts have len(model) - 1 bytes."""
    out, open_ = np.zeros(len(key)), np.arange(len(key))
    taken, known = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for order in range(len(model) - 1, -1, -1):
        level, rest = model[order], key[open_]
        context = rest >> np.int64(8 * (len(model) - order))
        at, seen = _found(level.context, context)
        gram, hit = _found(level.key, context << BYTE | rest & 255)
        if not len(level.key):
            continue
        n, q = level.total[at] - taken, level.symbols[at] - known
        with np.errstate(divide="ignore"):
            step = np.where(hit, np.log10((2 * level.n[gram] - 1) / np.maximum(2 * n, 1)), np.log10(q / np.maximum(2 * n, 1)))
        out[open_] += np.where(seen & (hit | (n > 0)), step, 0.0)
        taken, known = (np.where(seen, x[at], 0)[~hit] for x in (level.excluded, level.symbols))
        open_ = open_[~hit]
    out[open_] -= np.log10(np.maximum(256 - known, 1))
    return out


# Blocks of documents.

BLOCK_SQL = "block long, bucket int, grams binary, gram_counts binary, words binary, sizes binary, word_counts binary, low array<int>, low_counts array<long>"
BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("grams", "gram_counts", "words", "sizes", "word_counts")), ("low", pa.list_(pa.int32())), ("low_counts", pa.list_(pa.int64()))])
TEXTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary())])


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _bucket_of_grams(key: np.ndarray, buckets: int) -> np.ndarray:
    """By the last three context bytes."""
    h = (key >> np.int64(8 * (ORDER - 2))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _bucket_of_words(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def _spelled(words: list[bytes], line: np.ndarray) -> bytes:
    """A document's bytes from the numbers of its words; 0 is the end."""
    return b"".join(map(words.__getitem__, line.tolist()))


class _Block:
    def __init__(self, folder: str):
        self.folder, self.name, self.codes = folder, uuid.uuid4().int >> 65, _Codes({b"": 0})
        self.docs: list[tuple[int | None, bool, bool, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, text: str | None, folds: int, held: int) -> bool:
        parts = (text or "").encode().lower().split()
        parts.append(b"")
        line = np.fromiter(map(self.codes.__getitem__, parts), np.uint32, len(parts))
        fold = fold_of(doc_id, folds)
        self.docs.append((doc_id, fold == held, fold is not None and fold != held, line))
        self.tokens += len(line)
        return self.tokens > BLOCK_TOKENS or len(self.codes) > BLOCK_WORDS or len(self.docs) >= BLOCK_DOCS

    def close(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Writes the file; the block's grams and words by bucket, and one row without a bucket for short contexts."""
        squeeze = zstandard.ZstdCompressor(level=1)
        words = list(self.codes)
        stream, commit = write_atomically(self.folder, f"{self.name}.texts")
        with pa.ipc.new_stream(stream, TEXTS) as file:
            spell = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], "<u4")
            file.write_batch(_batch(TEXTS, [[None, None], [None, None], [squeezed(x, squeeze) for x in spell]]))
            for at in range(0, len(self.docs), 1000):
                part = self.docs[at : at + 1000]
                file.write_batch(_batch(TEXTS, [[d[0] for d in part], [d[1] for d in part], [squeezed(d[3], squeeze) for d in part]]))
        commit()
        full = [bytes([END]), *(w + bytes([BLANK]) for w in words[1:])]
        key, n = counted([_spelled(full, d[3]) for d in self.docs], [d[2] for d in self.docs])
        train = [d[3] for d in self.docs if d[2]]
        often = np.bincount(np.concatenate(train), minlength=len(words)) if train else np.zeros(len(words), np.int64)
        low, low_n = shorter(key[n > 0], n[n > 0], ORDER - SHARED_ORDER)
        yield _batch(BLOCK, [[self.name], [None], *[[None]] * 5, [low], [low_n]])
        order, start = _dealt(_bucket_of_grams(key, buckets), buckets)
        word_order, word_start = _dealt(_bucket_of_words(words, buckets), buckets)
        rows = []
        for b in range(buckets):
            own, named = order[start[b] : start[b + 1]], word_order[word_start[b] : word_start[b + 1]]
            if len(own) or len(named):
                listed = [words[i] for i in named.tolist()]
                columns = (np.diff(key[own], prepend=0), n[own], np.frombuffer(b"".join(listed), np.uint8), np.array([len(w) for w in listed], "<u4"), often[named])
                rows.append((self.name, b, *(squeezed(x, squeeze) for x in columns), None, None))
        yield _batch(BLOCK, list(zip(*rows, strict=True)))


def _blocks(folder: str, buckets: int, folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = block or _Block(folder)
                if block.add(doc_id, text, folds, held):
                    yield from block.close(buckets)
                    block = None
        if block is not None:
            yield from block.close(buckets)

    return run


PART_SQL = "block long, bucket int, lengths binary, counts binary, tokens long, distinct long"
PART = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])


def _bucket(sent):
    """A bucket's rows of all blocks to the code lengths of their grams and the training counts of their words."""

    def run(table: pa.Table) -> pa.Table:
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        below = levels(*sent.value, SHARED_ORDER, [])
        rows = [[np.cumsum(expanded(k, "<i8", expand)), expanded(c, "<i8", expand)] for k, c in zip(table.column("grams").to_pylist(), table.column("gram_counts").to_pylist(), strict=True)]
        key, n = added([r[0] for r in rows], [r[1] for r in rows])
        lengths = code_lengths(levels(key[n > 0], n[n > 0], ORDER, below), key).astype("<f4")
        asked: list[list[bytes]] = []
        often: dict[bytes, int] = {}
        for raw, sizes, counts in zip(*(table.column(x).to_pylist() for x in ("words", "sizes", "word_counts")), strict=True):
            ends = np.cumsum(expanded(sizes, "<u4", expand), dtype=np.int64).tolist()
            body = expand.decompress(raw) if raw else b""
            words = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            asked.append(words)
            for w, c in zip(words, expanded(counts, "<i8", expand).tolist(), strict=True):
                often[w] = often.get(w, 0) + c
        out = [(squeezed(lengths[np.searchsorted(key, r[0])], squeeze), squeezed(np.array([often[w] for w in words], "<i8"), squeeze)) for r, words in zip(rows, asked, strict=True)]
        first = [1] + [0] * (len(out) - 1)
        tokens, distinct = sum(often.values()), sum(c > 0 for c in often.values())
        return pa.Table.from_batches([_batch(PART, [table.column("block").to_pylist(), table.column("bucket").to_pylist(), [x[0] for x in out], [x[1] for x in out], [tokens * f for f in first], [distinct * f for f in first]])])

    return run


SCORE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(folder: str, buckets: int, total: int, distinct: int):
    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        table = table.sort_by("bucket")
        fs, base_dir = open_fs(folder)
        with fs.open_input_stream(f"{base_dir}/{table.column('block')[0].as_py()}.texts", compression=None) as stream:
            batches = list(pa.ipc.open_stream(stream))
        raw, sizes = (expanded(batches[0].column(2)[i].as_py(), k, expand) for i, k in ((0, "u1"), (1, "<u4")))
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        body = raw.tobytes()
        words = [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        full = [bytes([END]), *(w + bytes([BLANK]) for w in words[1:])]
        docs = [(d, h, expanded(c, "<u4", expand)) for batch in batches[1:] for d, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        texts = [_spelled(full, line) for _, _, line in docs]
        key, _ = counted(texts, [False] * len(texts))
        parts = {b: (x, y) for b, x, y in zip(*(table.column(c).to_pylist() for c in ("bucket", "lengths", "counts")), strict=True)}
        length, often = np.zeros(len(key)), np.zeros(len(words), np.int64)
        for which, kind, (order, start), into in ((0, "<f4", _dealt(_bucket_of_grams(key, buckets), buckets), length), (1, "<i8", _dealt(_bucket_of_words(words, buckets), buckets), often)):
            for b, part in parts.items():
                into[order[start[b] : start[b + 1]]] = expanded(part[which], kind, expand)
        base = np.log10((often + 0.5) / (total + 0.5 * (distinct + 1)))
        rows = []
        for (doc_id, held, line), text in zip(docs, texts, strict=True):
            score = float(length[np.searchsorted(key, np.sort(grams([text])))].sum())
            rows.append((doc_id, held, len(line), int((often[line] > 0).sum()), total, float(base[line].sum()), score))
        return pa.Table.from_batches([_batch(SCORE, list(zip(*rows, strict=True)))])

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    The rows whose crc32 of the identifier modulo folds is held are scored only; the others train the model as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = min(MOST_BUCKETS, 2 * max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    folder = shared_dir(spark, "ppm-texts")
    blocks = written(rows.mapInArrow(_blocks(folder, buckets, folds, held), BLOCK_SQL), "ppm-blocks")
    # One row for each gram of a short context, 2**24 at most.
    low = blocks.where("bucket IS NULL").select(F.explode(F.arrays_zip("low", "low_counts")).alias("x")).groupBy(F.col("x.low").alias("key")).agg(F.sum("x.low_counts").alias("n")).toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast((low.column("key").to_numpy().astype(np.int64), low.column("n").to_numpy().astype(np.int64)))
    asked = blocks.where("bucket IS NOT NULL").drop("low", "low_counts")
    parts = written(asked.groupBy("bucket").applyInArrow(_bucket(sent), PART_SQL), "ppm-parts")
    total, distinct = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # A task for each block, however small the parts are; more partitions than blocks, so that few share one.
    number = blocks.where("bucket IS NULL").count()
    return parts.drop("tokens", "distinct").repartition(4 * max(1, number), "block").groupBy("block").applyInArrow(_score(folder, buckets, total, distinct), SCORE_SQL)
