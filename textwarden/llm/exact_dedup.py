"""Exact dedup by a tree merge of sorted digest runs.

Every scanned partition becomes a run: its digests in order, each with its smallest identifier and its count. Runs meet
in binomial rounds: in a round, run r goes to run r // FAN_IN, where the runs that arrive are merged in order. A run of
level k holds FAN_IN ** k partitions and is cut by digest into as many segments, so a segment stays as large as a
partition's run on every level, and the last round leaves one run that is spread over all segments. A digest occurs once
per run, so even a group that holds a third of all rows gives a merge no more than FAN_IN entries.

Entries carry the text's byte length and a second, independent 64-bit digest. A merge compares both, so entries whose
SHA-256 agrees but whose texts differ stay apart, and the smallest identifier is verified on every level: a merge checks
that runs arrive in order and that no entry it passes on has a larger identifier than one it has seen.

Cases: null text counts as empty; a null identifier sorts after all others (a group of null identifiers only has a null
keep_id and nothing kept by identity); repeated identifiers count as rows of their own and share their fate; an empty
table gives an empty result; columns besides the two named are ignored. survivors() keeps one row of each distinct text,
also where identifiers are null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import attach, written

#: Runs that are merged in a round; a power of two, as a segment is cut by LEVEL_BITS bits of the digest.
LEVEL_BITS = 4
FAN_IN = 1 << LEVEL_BITS
#: Rows of a partition that are sorted at once; more make several pieces of its run.
PIECE_ROWS = 1_000_000
BLANKS = r"[\x20\x09-\x0D]+"
ENTRY = ["text_sha256", "n_bytes", "check64"]
#: The digest as the numbers of its four big-endian words, which are in order as its bytes are.
ROW = np.dtype([("sha", "<u8", 4), ("n_bytes", "<i8"), ("check64", "<i8"), ("none", "<i8"), ("keep_id", "<i8"), ("group_size", "<i8"), ("keep_rows", "<i8")])
RUN_SQL = "run int, segment int, entries binary"
RUN = pa.schema([("run", pa.int32()), ("segment", pa.int32()), ("entries", pa.binary())])
MERGED_SQL = "text_sha256 string, n_bytes long, check64 long, keep_id long, group_size long, keep_rows long"


def normalised(text):
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def entry(text) -> list:
    """The columns that tell texts apart."""
    norm = normalised(text)
    return [F.sha2(norm.cast("binary"), 256).alias("text_sha256"), F.octet_length(norm).cast("long").alias("n_bytes"), F.xxhash64(norm).alias("check64")]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the entry's columns and the run (the partition that read it)."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_norm"))
    return norm.select(
        "doc_id",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_norm").cast("long").alias("n_bytes"),
        F.xxhash64("_norm").alias("check64"),
        F.spark_partition_id().alias("run"),
    )


def in_order(rows: np.ndarray) -> bool:
    """Whether entries ascend strictly by digest, length and second digest."""
    same = np.ones(max(0, len(rows) - 1), bool)
    less = np.zeros(max(0, len(rows) - 1), bool)
    for column in (*(rows["sha"][:, k] for k in range(4)), rows["n_bytes"], rows["check64"]):
        less |= same & (column[:-1] < column[1:])
        same &= column[:-1] == column[1:]
    return bool(less.all())


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted entries of several runs as one sorted run: one entry for each text, with the least identifier."""
    rows = np.concatenate(runs)
    if not len(rows):
        return rows
    # The stable sort takes the runs, which ascend already, as they are and merges them.
    rows = rows[np.argsort(rows["sha"][:, 0], kind="stable")]
    columns = [rows["sha"][:, 0], rows["sha"][:, 1], rows["sha"][:, 2], rows["sha"][:, 3], rows["n_bytes"], rows["check64"]]
    head = columns[0][1:] == columns[0][:-1]
    if any((head & (c[1:] != c[:-1])).any() for c in columns[1:]):  # other texts under the first word
        order = np.lexsort(columns[::-1])
        rows, columns = rows[order], [c[order] for c in columns]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    out = rows[first].copy()
    out["none"] = np.minimum.reduceat(rows["none"], first)
    lowest = np.iinfo(np.int64).max
    out["keep_id"] = np.minimum.reduceat(np.where(rows["none"] > out["none"][of], lowest, rows["keep_id"]), first)
    own = (rows["none"] == out["none"][of]) & (rows["keep_id"] == out["keep_id"][of])
    out["group_size"] = np.add.reduceat(rows["group_size"], first)
    out["keep_rows"] = np.add.reduceat(np.where(own, rows["keep_rows"], 0), first)
    later = (rows["none"] < out["none"][of]) | ((rows["none"] == out["none"][of]) & (rows["keep_id"] < out["keep_id"][of]))
    if later.any() or not (out["keep_rows"] > 0).all():
        raise ValueError("a merged entry doesn't carry the least identifier")
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows (doc_id, entry, run) to its sorted run."""
    pieces, held, run = [], 0, 0

    def piece() -> pa.RecordBatch:
        own = merged(pieces)  # sorts what isn't in order yet
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([0], pa.int32()), pa.array([own.tobytes()], pa.binary())], schema=RUN)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.zeros(batch.num_rows, ROW)
        rows["sha"] = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), ">u8").reshape(-1, 4)
        rows["n_bytes"], rows["check64"] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        rows["none"] = np.asarray(batch.column(0).is_null()).astype(np.int64)
        rows["keep_id"] = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy()
        rows["group_size"] = rows["keep_rows"] = 1
        run = batch.column(4)[0].as_py()
        pieces.append(rows)
        held += len(rows)
        if held >= PIECE_ROWS:
            yield piece()
            pieces, held = [], 0
    if pieces:
        yield piece()


def _cut(level: int):
    """Segments of a level to those of the next one, addressed to the run that merges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - LEVEL_BITS * (level + 1))
        for batch in batches:
            for of, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = np.frombuffer(raw, ROW)
                segment = (rows["sha"][:, 0] >> shift).astype(np.int64)
                first = np.flatnonzero(np.diff(segment, prepend=-1))
                parts = [rows[a:b].tobytes() for a, b in zip(first, [*first[1:], len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([of // FAN_IN] * len(first), pa.int32()), pa.array(segment[first], pa.int32()), pa.array(parts, pa.binary())], schema=RUN)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The runs that arrive for a segment as one."""
    runs = [np.frombuffer(raw, ROW) for raw in table.column("entries").to_pylist()]
    if not all(map(in_order, runs)):
        raise ValueError("a run isn't sorted")
    return pa.Table.from_arrays([table.column("run").combine_chunks().slice(0, 1), table.column("segment").combine_chunks().slice(0, 1), pa.array([merged(runs).tobytes()], pa.binary())], schema=RUN)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a run as rows."""
    for batch in batches:
        for raw in batch.column(2).to_pylist():
            rows = np.frombuffer(raw, ROW)
            text = rows["sha"].astype(">u8").tobytes().hex()
            sha = pa.array([text[64 * i : 64 * i + 64] for i in range(len(rows))], pa.string())
            keep = pa.array(rows["keep_id"].astype(np.int64), mask=rows["none"] > 0)
            numbers = [pa.array(rows[c].astype(np.int64)) for c in ("n_bytes", "check64", "group_size", "keep_rows")]
            yield pa.RecordBatch.from_arrays([sha, *numbers[:2], keep, *numbers[2:]], names=[c.split()[0] for c in MERGED_SQL.split(", ")])


def merge_runs(rows: DataFrame, runs: int) -> DataFrame:
    """rows of digests() in runs 0 to runs - 1 to one row per distinct text: the entry, keep_id, group_size, keep_rows."""
    level, sorted_runs = 0, written(rows.select("doc_id", *ENTRY, "run").mapInArrow(_sort, RUN_SQL), "runs")
    while level == 0 or runs > 1:
        arrived = sorted_runs.mapInArrow(_cut(level), RUN_SQL).groupBy("run", "segment")
        sorted_runs = written(arrived.applyInArrow(_merge, RUN_SQL), "runs")
        level, runs = level + 1, -(-runs // FAN_IN)
    return sorted_runs.mapInArrow(_listed, MERGED_SQL)


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, the entry, keep_id, group_size and keep_rows."""
    rows = written(digests(docs, id_col, text_col), "digests")
    total, runs = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("run"), F.lit(0)) + 1).first()
    groups = written(merge_runs(rows, runs), "merged")
    return attach(rows.drop("run"), groups, ENTRY, "group_size", total)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept")
    return _found(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one per distinct text, with all columns of docs."""
    found = written(_found(docs, id_col, text_col), "found")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Identifiers that stand on several rows, or on none, don't name the row that stays.
    repeated = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_exact_id")), "repeated")
    kept = stay.select(F.col("doc_id").alias("_exact_id"))
    if repeated.isEmpty():
        return docs.join(kept, F.col(id_col) == F.col("_exact_id"), "left_semi")
    same = F.col(id_col).eqNullSafe(F.col("_exact_id"))
    plainly = docs.join(repeated, same, "left_anti").join(kept, F.col(id_col) == F.col("_exact_id"), "left_semi")
    names = ["_exact_sha", "_exact_size", "_exact_check"]
    told = docs.join(repeated, same, "left_semi").withColumns(dict(zip(names, entry(F.col(text_col)), strict=True)))
    wins = stay.select(F.col("doc_id").alias("_exact_id"), *(F.col(c).alias(f"{n}2") for c, n in zip(ENTRY, names, strict=True))).distinct()
    agree = same
    for n in names:
        agree = agree & (F.col(n) == F.col(f"{n}2"))
    return plainly.unionByName(told.join(wins, agree, "left_semi").dropDuplicates([id_col, *names]).drop(*names))
