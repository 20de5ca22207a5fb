"""Byte-level BPE encoding and decoding with Spark higher-order functions.

1. Tasks walk their documents in order and split them by the vocabulary's public pattern. Pieces are numbered within a
   block of documents; the documents' numbers go to a file of the block in the shared folder, its distinct pieces to a
   table, packed and dealt out by a hash of the piece.
2. Equal pieces of all blocks meet in a bucket, and the JVM folds every distinct word of the whole table with
   aggregate(): each step replaces the adjacent pair of the lowest rank, the leftmost of equals, by their merged id,
   looked up in a rank map that is a literal of the plan. It decodes the ids by concatenating the vocabulary's binary
   pieces.
3. The ids and bytes go back to the blocks that asked for them, and a task for each block joins them in the documents'
   order. So texts are never shuffled, and what a block may hold is bounded by BLOCK_WORDS, BLOCK_TOKENS and BLOCK_DOCS.

The map from pairs to merged ids is derived from the ranks: a pair of tokens can merge if its bytes are a token. Words of
over FOLD_BYTES bytes (runs without blanks) are merged by a heap in Python with the same rule, since the fold takes
quadratic time.

Cases: null text is empty: no tokens, digests of nothing; repeated rows are encoded each; null identifiers stay null;
strings of special tokens are ordinary text; lone surrogates can't occur in Spark strings; an empty table gives an empty
result; decoding ids that are no token raises.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import open_fs, released, shared_dir, write_atomically, written

#: Bounds of a block: distinct pieces, pieces and documents.
BLOCK_WORDS, BLOCK_TOKENS, BLOCK_DOCS = 600_000, 8_000_000, 500_000
MOST_BUCKETS = 1 << 16
FOLD_BYTES = 512
#: Numbers of documents that a task keeps before it writes them.
PENDING = 200_000
#: Lowest bits of the rank and of the place in the fold's state; NEVER is above every rank. Words have less than 1024 bytes.
RANK, PLACE, ID = 32, 22, 21
NEVER = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to the id of their joined bytes."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def heap_merge(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The fold's result for a long word, in n log n steps."""
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, x, y = heapq.heappop(heap)
        j = after[i] if i < n else n
        if ids[i] != x or j >= n or ids[j] != y:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r2 := pairs.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (r2, a, ids[a], ids[b]))
    return [x for x in ids if x >= 0]


class RankMap:
    """The literal map from pairs to merged ids: an array of longs in which a pair has two possible places.

    A pair is its ids in ID bits each; an entry is the pair above its merged id. Each place is the pair folded upon
    itself by two shifts, cut to the table's size; entries give way to each other until every one stands at one of its
    places, else other shifts are tried, then a larger table. Places without a pair are null.
    """

    def __init__(self, pairs: dict[tuple[int, int], int]):
        if max(map(max, pairs)) >= 1 << (ID - 1):
            raise ValueError("ids are too large for the map")
        keys = {left << ID | right: rank for (left, right), rank in pairs.items()}
        size = 1 << max(4, (2 * len(keys) - 1).bit_length())
        while True:
            for shifts in (((9, 18), (12, 19)), ((12, 18), (8, 19)), ((11, 18), (8, 17)), ((9, 21), (11, 17)), ((12, 27), (8, 18))):
                if (table := self._placed(keys, size - 1, shifts)) is not None:
                    self.mask, self.shifts, self.table = size - 1, shifts, table
                    return
            size *= 2

    @staticmethod
    def _placed(keys: dict[int, int], mask: int, shifts: tuple) -> list[int | None] | None:
        table: list[int | None] = [None] * (mask + 1)
        (a, b), (c, d) = shifts
        for key in keys:
            at = (key ^ key >> a ^ key >> b) & mask
            for _ in range(200):
                key, table[at] = table[at], key
                if key is None:
                    break
                first = (key ^ key >> a ^ key >> b) & mask
                at = first if first != at else (key ^ key >> c ^ key >> d) & mask
            else:
                return None
        return [None if key is None else key << ID | keys[key] for key in table]

    def column(self) -> Column:
        return F.from_json(F.lit("[" + ",".join("null" if x is None else str(x) for x in self.table) + "]"), "array<long>")

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        """The merged id of a pair, null if it has none."""

        def look(key: Column) -> Column:
            found = [F.get(table, key.bitwiseXOR(F.shiftright(key, a)).bitwiseXOR(F.shiftright(key, b)).bitwiseAND(F.lit(self.mask)).cast("int")) for a, b in self.shifts]
            ids = F.lit((1 << ID) - 1)
            return F.when(F.shiftright(found[0], ID) == key, found[0].bitwiseAND(ids)).when(F.shiftright(found[1], ID) == key, found[1].bitwiseAND(ids))

        return F.get(F.transform(F.array(F.shiftleft(left, ID).bitwiseOR(right)), look), F.lit(0))


def literal_pieces(ranks: dict[bytes, int]) -> Column:
    """A foldable array with the bytes of every id."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    return F.from_json(F.lit(json.dumps(pieces)), "array<binary>")


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """fold() with the map bound once, so that the plan holds one copy of it."""
    return F.get(F.transform(F.array(ranks.column()), lambda table: fold(word, ranks, table)), F.lit(0))


def fold(word: Column, ranks: RankMap, table: Column) -> Column:
    """Byte ids (array<int>) to token ids by ranked merges.

    The state is one array of longs: the rank of the pair that a token begins, the place of its first byte, and its id
    (RANK, PLACE and ID bits), behind a mark, so that every pair has a left neighbour. The least long is the next merge,
    the leftmost of equal ranks; it looks up the two pairs that are new. Places out of range give null, as pairs without
    a rank do.
    """
    every, low, ids = F.lit(1 << 30), F.lit((1 << RANK) - 1), F.lit((1 << PLACE) - 1)

    def ranked(left: Column, right: Column) -> Column:
        return F.coalesce(F.shiftleft(ranks.rank(table, left, right), RANK), F.lit(NEVER << RANK))

    def begin(all_ids: Column) -> Column:
        return F.transform(all_ids, lambda x, i: ranked(x, F.get(all_ids, i + 1)) + F.shiftleft(i.cast("long"), PLACE) + x)

    def step(state: Column, _: Column) -> Column:
        def merge(best: Column, at: Column) -> Column:
            before, new = F.get(state, at - 2), F.shiftright(best, RANK)
            left = F.when(at > 2, ranked(before.bitwiseAND(ids), new) + before.bitwiseAND(low)).otherwise(before)
            own = ranked(new, F.get(state, at + 1).bitwiseAND(ids)) + (best.bitwiseAND(low) - best.bitwiseAND(ids)) + new
            return F.concat(F.slice(state, F.lit(1), at - 2), F.array(left, own), F.slice(state, at + 2, every))

        def placed(best: Column) -> Column:
            found = F.transform(F.array(F.array_position(state, best).cast("int")), lambda at: merge(best, at))
            return F.when(best >= F.lit(NEVER << RANK), state).otherwise(F.get(found, F.lit(0)))

        return F.get(F.transform(F.array(F.array_min(state)), placed), F.lit(0))

    mark = F.array(F.lit(NEVER << RANK))
    steps = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
    start = F.concat(mark, F.get(F.transform(F.array(word.cast("array<long>")), begin), F.lit(0)))
    return F.aggregate(steps, start, step, lambda state: F.transform(F.slice(state, F.lit(2), every), lambda x: x.bitwiseAND(ids).cast("int")))


def concat_pieces(ids: Column, pieces: Column) -> Column:
    """The bytes of some ids."""
    return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.get(pieces, i)))


_TABLES: dict[str, tuple] = {}


def _tables(path: str) -> tuple:
    if path not in _TABLES:
        ranks = load_ranks(path)
        _TABLES[path] = [ranks[bytes([b])] for b in range(256)], pair_ranks(ranks), {r: t for t, r in ranks.items()}
    return _TABLES[path]


BLOCK_SQL = "block long, bucket int, pieces binary, codes binary"
BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("pieces", pa.binary()), ("codes", pa.binary())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("planes", pa.binary())])
#: A block that asks for a word, and the word's number there.
PLACE_OF = np.dtype([("block", "<i8"), ("code", "<u4")])
ASKED_SQL = "word binary, at binary"
PART_SQL = "block long, part binary"
PART = pa.schema([("block", pa.int64()), ("part", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _planes(codes: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes first, then their second ones: the upper ones are mostly zero."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class _Numbers(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        return code


class _Block:
    """Documents as numbers of their pieces, in a file of its own, and the pieces."""

    def __init__(self, folder: str):
        self.name = uuid.uuid4().int >> 65
        self.numbers = _Numbers()
        stream, self.commit = write_atomically(folder, f"{self.name}.texts")
        self.file = pa.ipc.new_stream(stream, TEXTS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1)))
        self.pending, self.held, self.tokens, self.docs = [], 0, 0, 0

    def add(self, doc_id: int | None, pieces: list[str]) -> None:
        self.pending.append((doc_id, np.fromiter(map(self.numbers.__getitem__, pieces), "<u4", len(pieces))))
        self.held += len(pieces)
        self.tokens += len(pieces)
        self.docs += 1
        if self.held > PENDING or len(self.pending) > 50_000:
            self.flush()

    def flush(self) -> None:
        """A batch of documents: the row of the last one has the numbers of all."""
        if self.pending:
            n = len(self.pending)
            body = _planes(np.concatenate([c for _, c in self.pending]))
            ids, sizes = [d for d, _ in self.pending], [len(c) for _, c in self.pending]
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([*[None] * (n - 1), body], pa.binary())], schema=TEXTS))
            self.pending, self.held = [], 0

    def full(self) -> bool:
        return len(self.numbers) > BLOCK_WORDS or self.tokens > BLOCK_TOKENS or self.docs >= BLOCK_DOCS

    def close(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Ends the file; the block's pieces by bucket, and a row without a bucket."""
        self.flush()
        self.file.close()
        self.commit()
        squeeze = zstandard.ZstdCompressor(level=1)
        raw = [w.encode() for w in self.numbers]
        bucket = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        rows = [(self.name, None, None, None)]
        for b in range(buckets):
            own = order[starts[b] : starts[b + 1]]
            if len(own):
                words = [raw[i] for i in own.tolist()]
                sizes = np.array([len(w) for w in words], "<u4")
                packed = np.array([len(words)], "<u4").tobytes() + _planes(sizes) + b"".join(words)
                rows.append((self.name, b, squeeze.compress(packed), squeeze.compress(_planes(np.diff(own, prepend=0)))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOCK.types, strict=True)], schema=BLOCK)


def _split(pattern: str, folder: str, buckets: int):
    """Documents to the files and pieces of their blocks."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    block = block or _Block(folder)
                    block.add(doc_id, find(text or ""))
                    if block.full():
                        yield from block.close(buckets)
                        block = None
        if block is not None:
            yield from block.close(buckets)

    return run


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column of rows of these sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _meet(table: pa.Table) -> pa.Table:
    """A bucket's pieces of all blocks to its distinct words, each with the places that ask for it."""
    expand, numbers = zstandard.ZstdDecompressor(), _Numbers()
    word, places = [], []
    for block, pieces, codes in zip(*(table.column(c).to_pylist() for c in ("block", "pieces", "codes")), strict=True):
        raw = expand.decompress(pieces)
        n = int.from_bytes(raw[:4], "little")
        ends = (4 + 4 * n + np.cumsum(_unplanes(raw[4 : 4 + 4 * n]), dtype=np.int64)).tolist()
        word.append(np.fromiter((numbers[raw[a:b]] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)), np.int64, n))
        at = np.empty(n, PLACE_OF)
        at["block"], at["code"] = block, np.cumsum(_unplanes(expand.decompress(codes)), dtype=np.int64)
        places.append(at)
    word, places = np.concatenate(word), np.concatenate(places)
    order = np.argsort(word, kind="stable")
    asked = np.bincount(word, minlength=len(numbers))
    return pa.Table.from_arrays([pa.array(list(numbers), pa.binary()), _binary(places[order].tobytes(), asked * PLACE_OF.itemsize)], names=["word", "at"])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of rows that begin at starts, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _pack(codes: np.ndarray, id_sizes: np.ndarray, ids: np.ndarray, body_sizes: np.ndarray, bodies: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Words by ascending number: the numbers' steps, sizes, ids and bytes."""
    head = np.array([len(codes), len(ids)], "<u4").tobytes()
    return squeeze.compress(head + b"".join(_planes(x) for x in (np.diff(codes.astype(np.int64), prepend=0), id_sizes, body_sizes, ids)) + bodies.tobytes())


def _unpack(part: bytes, expand: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = expand.decompress(part)
    n, m = np.frombuffer(raw[:8], "<u4").tolist()
    at = [8 + 4 * x for x in (0, n, 2 * n, 3 * n, 3 * n + m)]
    codes, id_sizes, body_sizes, ids = (_unplanes(raw[a:b]) for a, b in zip(at, at[1:], strict=False))
    return np.cumsum(codes, dtype=np.int64), id_sizes, body_sizes, ids, raw[at[-1] :]


def _words_of(part: bytes, expand: zstandard.ZstdDecompressor) -> int:
    """How many words a part holds."""
    with expand.stream_reader(part) as reader:
        return int.from_bytes(reader.read(4), "little")


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the rows of a list or binary column without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at[:-1], np.diff(at)


def _deal(path: str):
    """Words with their ids and bytes, and the blocks that ask for them, to a part for each block."""

    def parts(at: pa.Array, ids: pa.Array, bodies: pa.Array, squeeze: zstandard.ZstdCompressor) -> pa.RecordBatch:
        start, size = _offsets(at)
        places = np.frombuffer(at.buffers()[2], np.uint8)[start[0] : start[-1] + size[-1]].view(PLACE_OF)
        owner = np.repeat(np.arange(len(at)), size // PLACE_OF.itemsize)
        order = np.lexsort((places["code"], places["block"]))
        block, code, owner = places["block"][order], places["code"][order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        id_start, id_size = _offsets(ids)
        body_start, body_size = _offsets(bodies)
        values, raw = np.asarray(ids.values), np.frombuffer(bodies.buffers()[2] or b"", np.uint8)
        out = []
        for a, b in zip(first, np.append(first[1:], len(block)), strict=True):
            w = owner[a:b]
            out.append(_pack(code[a:b], id_size[w], values[_ragged(id_start[w], id_size[w])], body_size[w], raw[_ragged(body_start[w], body_size[w])], squeeze))
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(out, pa.binary())], schema=PART)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, ids, bodies, long = batch.columns
            if long.null_count < len(long):
                byte_ids, pairs, pieces = _tables(path)
                merged = [heap_merge([byte_ids[b] for b in w], pairs) for w in long.drop_null().to_pylist()]
                own = [b"".join(map(pieces.__getitem__, x)) for x in merged]
                yield parts(at.filter(long.is_valid()), pa.array(merged, pa.list_(pa.int32())), pa.array(own, pa.binary()), squeeze)
                short = long.is_null()
                at, ids, bodies = at.filter(short), ids.filter(short), bodies.filter(short)
            if len(at):
                yield parts(at, ids, bodies, squeeze)

    return run


_DECIMALS: list[bytes] = []


def _join(folder: str):
    """The words' ids and bytes in the order of each of a block's documents, as digests."""

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        block, packed = table.column("block")[0].as_py(), table.column("part").drop_null()
        del table
        n = sum(_words_of(p.as_buffer(), expand) for p in packed)
        texts, bodies, sizes = [b""] * n, [b""] * n, np.zeros(n, np.int64)
        for part in packed:
            codes, id_sizes, body_sizes, ids, raw = _unpack(part.as_buffer(), expand)
            sizes[codes] = id_sizes
            _DECIMALS.extend(b"%d" % i for i in range(len(_DECIMALS), int(ids.max(initial=0)) + 1))
            decimals = list(map(_DECIMALS.__getitem__, ids.tolist()))
            a = b = 0
            for code, i, j in zip(codes.tolist(), id_sizes.tolist(), body_sizes.tolist(), strict=True):
                texts[code], bodies[code] = b" ".join(decimals[a : a + i]), raw[b : b + j]
                a, b = a + i, b + j
        del packed
        out = []
        fs, base = open_fs(folder)
        with fs.open_input_stream(f"{base}/{block}.texts", compression=None) as stream:
            for batch in pa.ipc.open_stream(stream):
                codes = _unplanes(batch.column(2)[batch.num_rows - 1].as_py())
                counts, line = np.concatenate([[0], np.cumsum(sizes[codes])]), codes.tolist()
                at = 0
                for doc_id, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = line[at : at + length]
                    ids, body = hashlib.sha256(b" ".join([texts[i] for i in own])), hashlib.sha256(b"".join([bodies[i] for i in own]))
                    out.append((doc_id, int(counts[at + length] - counts[at]), ids.hexdigest(), body.hexdigest()))
                    at += length
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), DIGESTS.types, strict=True)], schema=DIGESTS)

    return run


def encode_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """The operator on words alone: adds ids (array<int>) and decoded (binary) to rows with an array of byte ids."""
    ranks = load_ranks(path)
    with_ids = words.withColumn("ids", fold_merges(F.col(column), RankMap(pair_ranks(ranks))))
    return with_ids.withColumn("decoded", concat_pieces(F.col("ids"), literal_pieces(ranks)))


def byte_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """A binary column's bytes as ids of single bytes: each byte as the character of its number, then that number."""
    table = F.array(*(F.lit(ranks[bytes([b])]) for b in range(256)))
    letters = F.split(F.decode(word, "ISO-8859-1"), "")
    return F.get(F.transform(F.array(table), lambda t: F.transform(letters, lambda x: F.get(t, F.ascii(x)))), F.lit(0))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded bytes)."""
    ranks = load_ranks(path)
    folder = shared_dir(docs.sparkSession, "bpe-texts")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = min(MOST_BUCKETS, 2 * max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = written(rows.mapInArrow(_split(pattern, folder, buckets), BLOCK_SQL), "bpe-words")
    names = blocks.where("bucket IS NULL").select("block")
    words = blocks.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_meet, ASKED_SQL)
    short = F.octet_length("word") <= FOLD_BYTES
    encoded = words.select("at", F.when(short, fold_merges(byte_ids(F.col("word"), ranks), RankMap(pair_ranks(ranks)))).alias("ids"), F.when(~short, F.col("word")).alias("long"))
    decoded = encoded.select("at", "ids", F.when(F.col("ids").isNotNull(), concat_pieces(F.col("ids"), literal_pieces(ranks))).alias("body"), "long")
    parts = decoded.mapInArrow(_deal(path), PART_SQL).unionByName(names.withColumn("part", F.lit(None).cast("binary")))
    # A task for each block, however small the parts are; more partitions than blocks, so that few share one.
    return parts.repartition(4 * max(1, names.count()), "block").groupBy("block").applyInArrow(_join(folder), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
