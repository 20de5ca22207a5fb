"""Token-id shards: independent zstandard frames, a trailing seek table and a checksum for every frame.

A shard is the concatenation of zstandard frames, each the little-endian unsigned 32-bit ids of some whole documents,
then two skippable frames: the document index (doc_id, frame, offset within it, ids) and last the seek table in the
public seekable layout (compressed size, decompressed size, and the low half of XXH64 for each frame). A reader takes
the seek table from the end of the file and inflates only the frames of the documents that it wants.

Ids come from the tokenizers library. The pre-tokenizer never joins text across a single space or line feed that stands
between two other characters, so a text without longer runs of blanks is cut there, each distinct piece is encoded once
per worker and its ids are joined; any other text is encoded whole, and so is one that holds a token which the
vocabulary adds to its pieces (the library gives such a string its own id).

Cases: null text is empty and yields the end id alone; null identifiers sort first; repeated rows are stored each for
itself; an empty table writes no shard; very long texts make a frame of their own.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import open_fs, shared_dir, write_atomically, written

FRAME_BYTES, SHARD_BYTES = 1 << 20, 16 << 20
#: Public constants of the skippable and seekable zstandard layouts.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = struct.Struct("<qqqqq")
CACHE = 1_000_000
#: Blanks other than the space and the line feed.
OTHER_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def touching(text: str) -> bool:
    """Whether two blanks stand side by side; such a text is encoded whole."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return True
    return any(c in text for c in OTHER_BLANKS)


#: Marks that are pieces of their own behind letters.
MARKS = string.punctuation
PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    return PACKS[len(ids)](*ids) if len(ids) < len(PACKS) else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to bytes of little-endian uint32 ids."""

    def __init__(self, path: str):
        # A task has one core: the library's own threads cost a fifth more CPU time than they save.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that have an id of their own wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of what follows a space, under the text up to the next one; a line feed in front stands for the space.
        self.known: dict[str, bytes] = {}
        #: Ids of runs of marks that stand behind letters.
        self.marks: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @cached_property
    def feed(self) -> bytes:
        return self.whole(["\n"])[0]

    def learn(self, parts: set[str]) -> None:
        """Ids of new parts. To the pre-tokenizer a single line feed, and marks behind letters, are pieces of their own."""
        known, marks, marked = self.known, self.marks, []
        plain = set()
        for p in parts:
            stem = p.rstrip(MARKS)
            if len(stem) < len(p) and stem.lstrip("\n").isalpha():
                marked.append((p, stem, p[len(stem) :]))
                plain.add(stem)
            else:
                plain.add(p)
        plain.difference_update(known)
        for p, ids in zip(plain, self.whole([p[1:] if p[:1] == "\n" else " " + p for p in plain]), strict=True):
            known[p] = self.feed + ids if p[:1] == "\n" else ids
        tails = list({tail for _, _, tail in marked}.difference(marks))
        marks.update(zip(tails, self.whole(tails), strict=True))
        for p, stem, tail in marked:
            known[p] = known[stem] + marks[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, met = [], set()
        for text in texts:
            parts = None
            if not touching(text) and not any(t in text for t in self.added):
                parts = ("\n" + text).replace("\n", " \n").split(" ")
                del parts[0]
                met.update(parts)
            cut.append(parts)
        if len(self.known) > CACHE:  # what stands in these texts stays
            self.known = {p: ids for p in met if (ids := self.known.get(p)) is not None}
            self.marks.clear()
        if new := met.difference(self.known):
            self.learn(new)
        ids = self.known.__getitem__
        return [self.whole([text])[0] if parts is None else b"".join(map(ids, parts))[4:] for text, parts in zip(texts, cut, strict=True)]


class ShardWriter:
    """Documents in the order they are added; close() writes the index and the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.stream, self.frame_bytes, self.squeeze = stream, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[bytes] = []
        self.buffer = bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.buffer and len(self.buffer) + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append(INDEX.pack(doc_id is None, doc_id or 0, len(self.frames), len(self.buffer), len(ids)))
        self.buffer += ids

    def flush(self) -> None:
        data = self.squeeze.compress(bytes(self.buffer))
        self.frames.append((len(data), len(self.buffer), xxhash.xxh64_intdigest(self.buffer) & 0xFFFFFFFF))
        self.stream.write(data)
        self.buffer = bytearray()

    def close(self) -> None:
        if self.buffer:
            self.flush()
        index = self.squeeze.compress(b"".join(self.docs))
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class ShardReader:
    """Random access to a shard's documents."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("the file has no seek table")
        start = size - 9 - 12 * count
        self.frames = [struct.unpack_from("<III", self.file.read_at(12 * count, start), 12 * i) for i in range(count)]
        self.at = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).tolist()
        tag, length = struct.unpack("<II", self.file.read_at(8, self.at[-1]))
        if tag != SKIPPABLE_INDEX:
            raise ValueError("the file has no document index")
        self.docs = list(INDEX.iter_unpack(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, self.at[-1] + 8))))

    def frame(self, k: int) -> bytes:
        size, full, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, self.at[k]), max_output_size=full)
        if len(data) != full or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; with wanted, only those documents, and only their frames are read."""
        held, data = -1, b""
        for null, doc_id, frame, offset, length in self.docs:
            if wanted is not None and (null or doc_id not in wanted):
                continue
            if frame != held:
                held, data = frame, self.frame(frame)
            yield None if null else doc_id, data[offset : offset + length]


def _size(docs: DataFrame, rows: DataFrame) -> int:
    """Bytes of the input as the optimizer knows them (the files' size); where it doesn't, those of the texts."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards of about shard_bytes of input each in ascending identifier order; returns their table (shard, path, docs, tokens), materialised."""
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(max(1, -(-_size(docs, rows) // shard_bytes)), "doc_id").sortWithinPartitions("doc_id")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        writer = None
        tokens = count = number = 0
        for batch in batches:
            if writer is None and batch.num_rows:
                number, name = batch.column(2)[0].as_py(), f"{uuid.uuid4().hex}.ids.zst"
                stream, commit = write_atomically(folder, name)
                writer, encoder = ShardWriter(stream), _encoder(tokenizer_path)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
                    tokens, count = tokens + len(ids) // 4 + 1, count + 1
        if writer is not None:
            writer.close()
            commit()
            yield pa.RecordBatch.from_pydict({"shard": [number], "path": [f"{folder}/{name}"], "docs": [count], "tokens": [tokens]})

    return written(ordered.mapInArrow(shard, "shard long, path string, docs long, tokens long"), "token-shards")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def read_digests(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The first ids of the shards come from a running sum over the shards' table, a row for each file.
    """
    before, starts = 0, []
    for number, path, tokens in sorted(shards.select("shard", "path", "tokens").collect()):
        starts.append((path, before))
        before += tokens
    spark = shards.sparkSession
    files = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)), "path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc_id, ids in ShardReader(path).read():
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    return read_digests(write_tokens(docs, shared_dir(spark, "tokens"), tokenizer_path, end_id))
