"""Dataset audit: canonical records, duplicates, conflicts, leakage, distributions and validation.

Records have: seq (a total order), file, split, protected, task, text, normalized_text, exact_hash, normalized_hash,
label, signature, group_id, category. Reports of pairs show the first few of each text or group, as many as a parameter
says; duplicate_groups(), split_leakage() and group_leakage(limit=None) leave nothing out.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.text import normalize_key, stable_hash

# Parts of file names and the split they mean, in order.
SPLIT_RULES = [("train", "train"), ("validation", "validation"), ("calibration", "calibration"), ("development", "development"), ("challenge", "challenge"), ("blind", "blind"), ("real_world_test", "real_world_test"), ("test", "test")]
PROTECTED_WORDS = ["calibration", "development", "challenge", "blind", "real_world_test", "test"]


def infer_split(name: Column) -> Column:
    n, out = F.lower(name), None
    for part, split in SPLIT_RULES:
        cond = n.contains(part) | (n.contains("dev") & ~n.contains("development") if part == "validation" else F.lit(False))
        out = F.when(cond, split) if out is None else out.when(cond, split)
    return out.otherwise("unknown")


def is_protected(name: Column) -> Column:
    n = F.lower(name)
    return ~n.contains("hard_train") & n.rlike("|".join(PROTECTED_WORDS))


#: Roles that a manifest of known files may give; anything else is proposed from the file's structure.
ROLES = ["MULTITASK_TRAIN_TOKEN_SOURCE", "MULTITASK_VALIDATION_TOKEN_SOURCE", "MULTITASK_TRAIN_SEQUENCE_SOURCE", "MULTITASK_VALIDATION_SEQUENCE_SOURCE", "CALIBRATION_ONLY", "INTERNAL_TEST_ONLY", "HARD_TEST_ONLY", "FINAL_BLIND_TEST_ONLY", "PROTECTED_EVALUATION", "SUPERSEDED", "BASELINE_REFERENCE_ONLY", "UNKNOWN"]


def propose_role(name: Column, task: Column, split: Column, protected: Column, known: dict[str, str] | None = None, token_family: str = "token_classification") -> Column:
    """The role of a dataset file: the known one of its name, else by protection and split, else what an old token file
    (its name holds token_family) or a sequence file of version 2 is kept for; UNKNOWN otherwise."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for file, role in (known or {}).items():
        if role not in ROLES:
            raise ValueError(f"unknown role: {role}")
        out = out.when(name == file, role)
    return (
        out.when(protected & split.isin("test", "development"), "INTERNAL_TEST_ONLY").when(protected & split.isin("challenge", "real_world_test"), "HARD_TEST_ONLY").when(protected, "PROTECTED_EVALUATION")
        .when((task == "token") & name.contains(token_family), "SUPERSEDED").when((task == "sequence") & name.endswith("_v2.jsonl"), "BASELINE_REFERENCE_ONLY").otherwise("UNKNOWN")
    )


def audit_records(rows: DataFrame) -> DataFrame:
    """Adds the normalised text and both hashes to rows with a text."""
    key = normalize_key(F.col("text"))
    return rows.withColumns({"normalized_text": key, "exact_hash": stable_hash(F.col("text"))}).withColumn("normalized_hash", stable_hash(F.col("normalized_text")))


def _sides(records: DataFrame, cols: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    return tuple(records.where(F.col(key) != "").select(F.col(key).alias("key"), *(F.col(c).alias(f"{c}_{s}") for c in cols)) for s in "ab")


def _first(side: DataFrame, suffix: str, n: int, *also: str) -> DataFrame:
    """The first n rows of each key; Spark limits them before the shuffle, so a hot key stays small."""
    w = Window.partitionBy("key", *also).orderBy(f"seq_{suffix}")
    return side.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def duplicate_groups(records: DataFrame, key: str) -> DataFrame:
    """One row per text that stands in several records: key, its first record, copies, and whether labels or signatures
    differ. Nothing is capped and nothing is expanded into pairs."""
    named = records.where(F.col(key) != "").withColumn("_s", F.col("signature") if "signature" in records.columns else F.lit(None).cast("string"))
    found = named.groupBy(F.col(key).alias("key")).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("copies"), ((F.countDistinct("label") > 1) | (F.countDistinct("_s") > 1)).alias("conflict"))
    return found.where("copies > 1")


def duplicate_pairs(records: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """A report: the first `limit` pairs of records with equal keys, in arrival order, with a conflict flag (other labels,
    or two signatures that differ). duplicate_groups() has all of them, without pairs.

    The first pairs of a key lie among its first limit + 1 members, so only those are joined.
    """
    records = records if "signature" in records.columns else records.withColumn("signature", F.lit(None).cast("string"))
    a, b = _sides(records, ["seq", "file", "label", "signature"], key)
    differ = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))
    pairs = _first(a, "a", limit + 1).join(_first(b, "b", limit + 1), "key").where("seq_a < seq_b").withColumn("conflict", differ("label") | differ("signature"))
    w = Window.partitionBy("key").orderBy("seq_a", "seq_b")
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def label_conflicts(records: DataFrame, limit: int = 50) -> DataFrame:
    """A report: pairs with different labels or signatures among the first `limit` pairs of each text that has several."""
    labelled = records.where("label IS NOT NULL")
    signature = F.coalesce("signature", F.lit("")) if "signature" in records.columns else F.lit("")
    mixed = labelled.groupBy("normalized_hash").agg(F.countDistinct("label", signature).alias("_n")).where("_n > 1").select("normalized_hash")
    return duplicate_pairs(labelled.join(mixed, "normalized_hash", "left_semi"), "normalized_hash", limit).where("conflict")


def split_leakage(records: DataFrame) -> DataFrame:
    """Training records whose text stands in a protected file: a row for each record and file, with the file's first
    record and its number of copies (copies aren't expanded into pairs)."""
    a, b = _sides(records, ["seq", "file", "split", "protected"], "normalized_hash")
    held = b.where("protected_b").groupBy("key", "file_b").agg(F.min("seq_b").alias("seq_b"), F.count(F.lit(1)).alias("copies_b"))
    return a.where("split_a = 'train' AND NOT protected_a").join(held, "key").select("key", "seq_a", "file_a", "seq_b", "file_b", "copies_b", F.lit("HIGH").alias("severity"))


def group_leakage(records: DataFrame, limit: int | None = 20) -> DataFrame:
    """The first `limit` pairs of records of one group in different splits; HIGH if training meets protected rows.

    Each of them lies among the first 2 * limit members of its group's split, so only those are joined. Without a limit,
    each record meets the first record of every other split of its group, so no record of a leak is left out.
    """
    a, b = _sides(records, ["seq", "split", "protected"], "group_id")
    if limit is None:
        a, b = a, b.groupBy("key", "split_b", "protected_b").agg(F.min("seq_b").alias("seq_b"))
        pairs = a.join(b, "key").where("split_a <> split_b")
    else:
        pairs = _first(a, "a", 2 * limit, "split_a").join(_first(b, "b", 2 * limit, "split_b"), "key").where("seq_a < seq_b AND split_a <> split_b")
        pairs = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy("seq_a", "seq_b"))).where(F.col("_k") <= limit)
    high = ((F.col("split_a") == "train") & F.col("protected_b")) | ((F.col("split_b") == "train") & F.col("protected_a"))
    return pairs.select(F.col("key").alias("group_id"), "seq_a", "split_a", "seq_b", "split_b", F.when(high, "HIGH").otherwise("MEDIUM").alias("severity"))


def cross_task_overlaps(tokens: DataFrame, sequences: DataFrame, conflicts: DataFrame) -> DataFrame:
    """tokens (normalized_hash, entity_count) against sequences (normalized_hash, label), folded by text: each
    combination with its numbers of rows and its class."""
    t = tokens.groupBy("normalized_hash", (F.col("entity_count") > 0).alias("has_entities")).agg(F.count(F.lit(1)).alias("token_rows"))
    s = sequences.groupBy("normalized_hash", "label").agg(F.count(F.lit(1)).alias("sequence_rows"))
    c = conflicts.select("normalized_hash").distinct().withColumn("_c", F.lit(True))
    agree = (F.col("has_entities") & (F.col("label") == "LEAK")) | (~F.col("has_entities") & (F.col("label") == "NON_LEAK"))
    kind = F.when(F.col("_c"), "CONFLICT_REVIEW_REQUIRED").when(agree, "CONSISTENT").otherwise("POSSIBLY_VALID_DIFFERENCE")
    return t.join(s, "normalized_hash").join(c, "normalized_hash", "left").select("normalized_hash", "has_entities", "label", "token_rows", "sequence_rows", kind.alias("classification"))


LENGTH_STEP, PREFIX, LEAST = 40, 16, 20


#: Texts of either side of a block that meet under one key of the join.
CELL = 50


def _near_sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct training and distinct protected texts with their prefix p and length bucket b (training: one either way too)."""
    long = records.where(F.length("normalized_text") >= LEAST)
    fold = lambda d, s: d.groupBy("normalized_hash", "normalized_text").agg(F.min("seq").alias(f"seq_{s}")).select(f"seq_{s}", F.col("normalized_hash").alias(f"normalized_hash_{s}"), F.col("normalized_text").alias(f"normalized_text_{s}"), F.substring("normalized_text", 1, PREFIX).alias("p"), F.floor(F.length("normalized_text") / LENGTH_STEP).alias("b"))
    bucket = F.col("b")
    train = fold(long.where("split = 'train' AND NOT protected"), "a").withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    return train, fold(long.where("protected"), "b")


def _cell_numbers(side: DataFrame, name: str) -> DataFrame:
    return side.groupBy("p", "b").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))


def near_candidates(records: DataFrame, comparisons: int | None = None) -> DataFrame:
    """Distinct training against distinct protected texts by length bucket (one either way) and prefix; an exploded
    equi-join, in which blocks of many protected texts are dealt into cells by hash. With comparisons, only with the
    first so many protected texts of each block."""
    train, held = _near_sides(records)
    if comparisons is not None:
        held = held.withColumn("_r", F.row_number().over(Window.partitionBy("p", "b").orderBy("seq_b"))).where(F.col("_r") <= comparisons).drop("_r")
    cells = _cell_numbers(held, "_n")
    held = held.join(cells, ["p", "b"]).withColumn("_c", F.pmod(F.xxhash64("normalized_hash_b"), F.col("_n")).cast("int")).drop("_n")
    train = train.join(cells, ["p", "b"]).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return train.join(held, ["p", "b", "_c"]).drop("_c").where("normalized_hash_a <> normalized_hash_b")


def _near_cells(records: DataFrame) -> DataFrame:
    """The candidates unexpanded: each block is dealt into cells of about CELL training by CELL protected texts (_i, _j),
    and every text stands once in each of its cells, so that no cell is large and no pair is a row."""
    train, held = _near_sides(records)
    numbers = _cell_numbers(train, "_n").join(_cell_numbers(held, "_m"), ["p", "b"])

    def dealt(side: DataFrame, s: str, own: str, other: str, i: str, j: str) -> DataFrame:
        rows = side.join(numbers, ["p", "b"]).withColumn(i, F.pmod(F.xxhash64(f"normalized_hash_{s}"), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("p", "b", "_i", "_j", F.lit(s == "b").alias("held"), F.col(f"seq_{s}").alias("seq"), F.col(f"normalized_hash_{s}").alias("hash"), F.col(f"normalized_text_{s}").alias("text"))

    return dealt(train, "a", "_n", "_m", "_i", "_j").unionByName(dealt(held, "b", "_m", "_n", "_j", "_i"))


def char_places(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


#: Characters between two looks at whether a comparison can still succeed.
LOOK = 64


def common_length(a: str, b: str, places: dict[str, int], need: int) -> int | None:
    """Length of the longest common subsequence of a and b (with b's places), a machine word of b at a time; None if it is
    below need. What the first i characters of a share with b lies in b's first i + len(b) - need characters."""
    n, m = len(a), len(b)
    full, free = (1 << m) - 1, (1 << m) - 1
    for i, c in enumerate(a, 1):
        hit = free & places.get(c, 0)
        free = (free + hit) | (free - hit)
        if not i % LOOK:
            free &= full
            j = min(m, i + m - need)
            if j - (free & ((1 << j) - 1)).bit_count() + n - i < need:
                return None
    found = m - (free & full).bit_count()
    return found if found >= need else None


def bounded_distance(a: str, b: str, places: dict[str, int], most: int) -> int | None:
    """Levenshtein distance of a and b (with b's places) by columns of differences, a machine word of b at a time; None if
    it is above most. The distance of the first i characters of both exceeds it by the difference of the lengths at most."""
    n, m = len(a), len(b)
    full, slack = (1 << m) - 1, abs(n - m)
    up, down = full, 0
    for i, c in enumerate(a, 1):
        x = places.get(c, 0)
        same = ((((x & up) + up) ^ up) | x | down) & full
        right, left = down | (full ^ (same | up)), same & up
        right = (right << 1 | 1) & full
        up, down = ((left << 1) & full) | (full ^ (same | right)), right & same
        if not i % LOOK and i <= m:
            low = (1 << i) - 1
            if i + (up & low).bit_count() - (down & low).bit_count() - slack > most:
                return None
    found = n + up.bit_count() - down.bit_count()
    return found if found <= most else None


#: An edit touches GRAM runs of so many characters, so it changes at most 2 * GRAM of the counts.
GRAM = 5


def gram_counts(texts: list[str], bins: int) -> np.ndarray:
    """Counts of each text's runs of GRAM characters, by hash into bins (a power of 2); runs that share a bin only hide differences."""
    out = np.zeros((len(texts), bins), dtype=np.int32)
    for row, text in zip(out, texts, strict=True):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        runs = np.zeros(max(0, len(codes) - GRAM + 1), dtype=np.uint64)
        for k in range(GRAM):
            runs = runs * np.uint64(1_000_003) + codes[k : k + len(runs)]
        row += np.bincount((runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % bins, minlength=bins).astype(np.int32)
    return out


def _near_distances(train: list[tuple], held: list[tuple], least: float) -> list[tuple]:
    """(seq_a, seq_b, score) of the pairs of a cell whose normalised Levenshtein similarity is at least `least`."""
    out = []
    bins = min(1 << 15, 1 << (8 * max(len(t) for _, _, t in train)).bit_length())
    counts, lengths = gram_counts([t for _, _, t in train], bins), np.array([len(t) for _, _, t in train])
    for seq_b, hash_b, b in held:
        # No distance is below the difference of the lengths, nor below the share of the runs that differ.
        longer = np.maximum(lengths, len(b))
        most = np.floor((1.0 - least) * longer + 1e-9).astype(np.int64)
        near = (np.abs(lengths - len(b)) <= most) & (np.abs(counts - gram_counts([b], bins)).sum(axis=1) <= 2 * GRAM * most)
        places = char_places(b) if near.any() else {}
        for k in np.flatnonzero(near):
            seq_a, hash_a, a = train[k]
            if hash_a != hash_b and (d := bounded_distance(a, b, places, int(most[k]))) is not None and (score := 1.0 - d / int(longer[k])) >= least:
                out.append((seq_a, seq_b, score))
    return out


def _near_ratios(train: list[tuple], held: list[tuple], least: float, top: int | None, best: list[float]) -> list[tuple]:
    """(seq_a, seq_b, score) of the pairs of a cell whose Ratcliff-Obershelp ratio is at least `least`.

    Matched characters form a common subsequence, so its length bounds the ratio. best holds the task's top scores so far
    (a heap); with top, a pair that so many others exceed even when rounded is left out.
    """

    def needed(total: int) -> int:
        floor = max(least, best[0] - 1e-4) if top and len(best) == top else least
        need = int(floor * total / 2)
        while need and 2.0 * (need - 1) / total >= floor:
            need -= 1
        while 2.0 * need / total < floor:
            need += 1
        return need

    bounds = []
    for j, (_, hash_b, b) in enumerate(held):
        places: dict[str, int] = {}
        for i, (_, hash_a, a) in enumerate(train):
            total = len(a) + len(b)
            if hash_a != hash_b and (need := needed(total)) <= min(len(a), len(b)):
                places = places or char_places(b)
                if (shared := common_length(a, b, places, need)) is not None:
                    bounds.append((2.0 * shared / total, j, i))
    out, matchers = [], {}
    for bound, j, i in sorted(bounds, reverse=True):
        (seq_a, _, a), (seq_b, _, b) = train[i], held[j]
        if top and len(best) == top and bound < best[0] - 1e-4:
            break
        if j not in matchers:
            matchers[j] = difflib.SequenceMatcher(None, "", b)
        matchers[j].set_seq1(a)
        if (score := matchers[j].ratio()) >= least:
            out.append((seq_a, seq_b, score))
            if top:
                (heapq.heappush if len(best) < top else heapq.heappushpop)(best, score)
    return out


#: The number of a worker's task and the task's best scores.
_BEST: tuple[int, list[float]] = (-1, [])


def _task_best() -> list[float]:
    global _BEST
    task = TaskContext.get().taskAttemptId()
    if _BEST[0] != task:
        _BEST = task, []
    return _BEST[1]


def near_duplicates(records: DataFrame, least: float = 0.88, native: bool = False, top: int | None = 100) -> DataFrame:
    """Candidates at or above a similarity: Ratcliff-Obershelp, or (native) normalised Levenshtein. All candidates are
    compared, cell by cell; bounds that hold for every pair spare most of them the full comparison."""
    kind = records.schema["seq"].dataType.simpleString()

    def compare(cell: pa.Table) -> pa.Table:
        train, held = [], []
        for protected, *text in zip(*(cell.column(c).to_pylist() for c in ("held", "seq", "hash", "text")), strict=True):
            (held if protected else train).append(tuple(text))
        found: list[tuple] = []
        if train and held:
            found = _near_distances(train, held, least) if native else _near_ratios(train, held, least, top, _task_best())
        return pa.table({"seq_a": pa.array([r[0] for r in found], cell.schema.field("seq").type), "seq_b": pa.array([r[1] for r in found], cell.schema.field("seq").type), "score": pa.array([r[2] for r in found], pa.float64())})

    keys = ["p", "b", "_i", "_j"]
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = _near_cells(records).repartition(tasks, *keys).groupBy(*keys)
    found = cells.applyInArrow(compare, f"seq_a {kind}, seq_b {kind}, score double").select("seq_a", "seq_b", F.round("score", 4).alias("score"))
    return found.orderBy(F.desc("score"), "seq_a", "seq_b").limit(top) if top else found


def value_counts(records: DataFrame, key: str, column: str) -> DataFrame:
    """key and a map from each value of column to its number; missing values count as MISSING."""
    counts = records.groupBy(key, F.coalesce(F.col(column).cast("string"), F.lit("MISSING")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(column))


def inventory(records: DataFrame) -> DataFrame:
    """Per file: records, groups, categories, surplus copies, empty texts and the number of labels."""
    extra = lambda c: F.count(c) - F.countDistinct(c)
    return records.groupBy("file").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("category").alias("categories"), extra("exact_hash").alias("exact_duplicates"), extra("normalized_hash").alias("normalized_duplicates"),
        F.count_if(F.col("normalized_text") == "").alias("empty"), F.count_if(F.col("label") == "LEAK").alias("leaks"), F.count_if(F.col("label") == "NON_LEAK").alias("non_leaks"),
    )


def dataset_info(records: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """inventory() with what an audit says of each file besides: groups, maps of labels and categories, the union of its
    records' fields, malformed rows, and the preview of its first text. records may have fields (array<string>)."""
    one = records.groupBy("file").agg(
        F.countDistinct(F.nullif("group_id", F.lit(""))).alias("groups"), F.min_by(F.when(F.length("normalized_text") > 120, F.concat(F.substring("normalized_text", 1, 120), F.lit("..."))).otherwise(F.col("normalized_text")), F.when(F.col("normalized_text") != "", F.col("seq"))).alias("sample_text_preview"),
    )
    out = inventory(records).join(one, "file")
    for column in ("label", "category"):
        out = out.join(value_counts(records, "file", column).withColumnRenamed(column, f"{column}_counts"), "file")
    if "fields" in records.columns:
        fields = records.select("file", F.explode("fields").alias("f")).distinct().groupBy("file").agg(F.array_sort(F.collect_list("f")).alias("fields"))
        out = out.join(fields, "file", "left")
    bad = malformed.groupBy("file").agg(F.count(F.lit(1)).alias("malformed_count")) if malformed is not None else None
    return out.withColumn("malformed_count", F.lit(0).cast("long")) if bad is None else out.join(bad, "file", "left").fillna(0, ["malformed_count"])


def distribution(records: DataFrame, field: str) -> DataFrame:
    """Counts of a field's values per file, and their percentage."""
    counts = records.groupBy("file", F.coalesce(F.col(field).cast("string"), F.lit("MISSING")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("file")), 4))


def entity_types(records: DataFrame, tags: str = "tag_names", key: str | None = None) -> DataFrame:
    """How many tags of each entity type stand in records (of each key), and in how many of them; O tags don't count."""
    keys = [key] if key else []
    exploded = records.select(*keys, "seq", F.explode(tags).alias("_t")).where("_t <> 'O'").select(*keys, "seq", F.regexp_replace("_t", "^[BI]-", "").alias("type"))
    each = exploded.groupBy(*keys, "type", "seq").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*keys, "type").agg(F.sum("_n").alias("labels"), F.count(F.lit(1)).alias("records"))


def length_statistics(records: DataFrame, key: str = "file") -> DataFrame:
    """Count, extremes, mean, median and nearest-rank percentiles of text lengths.

    Percentiles are taken from counts per length, so a file that holds most rows is folded before it is ordered.
    """
    lengths = records.groupBy(key, F.length("normalized_text").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    ranked = lengths.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("len"))})
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("len")))
    near = lambda p: at(F.bround(F.lit(p) * (F.col("n") - 1)))
    median = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / F.lit(2.0)
    return ranked.groupBy(key).agg(F.max("n").alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.round(F.sum(F.col("len") * F.col("c")) / F.max("n"), 4).alias("mean_len"), F.round(median, 4).alias("median_len"), near(0.95).alias("p95"), near(0.99).alias("p99"))


def detect_task(record: Column) -> Column:
    """token, sequence or unknown by the keys that a JSON record has, whatever their values."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.when(F.arrays_overlap(keys, F.array(*map(F.lit, ("tokens", "ner_tags", "tag_names", "typed_spans", "entities")))), "token").when(F.arrays_overlap(keys, F.array(F.lit("label"), F.lit("label_name"))), "sequence").otherwise("unknown")


def token_labels(tag_names: Column, ner_tags: Column, labels: Column) -> Column:
    """Label names of a record: its own, else those of its ids in labels (array<string>), UNKNOWN_ID_n for ids beyond."""
    named = F.transform(ner_tags, lambda i: F.coalesce(F.when(i >= 0, F.get(labels, i.cast("int"))), F.concat(F.lit("UNKNOWN_ID_"), i.cast("string"))))
    return F.coalesce(tag_names, named, F.array().cast("array<string>"))


def signature(labels: Column, spans: Column) -> Column:
    """What two records of one text must share to agree: labels and spans (start, end, type, text) as JSON."""
    same = F.transform(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,type:string,text:string>>")), lambda x: F.struct(x["end"].alias("end"), x["start"].alias("start"), x["text"].alias("text"), x["type"].alias("type")))
    return F.to_json(F.struct(labels.alias("labels"), same.alias("spans")), {"ignoreNullFields": "false"})


def bio_violations(tags: DataFrame, allowed: list[str]) -> DataFrame:
    """rec, pos and every error of each tag; an I tag may follow B or I of its type."""
    tags = tags.withColumn("_b", F.lag("tag").over(Window.partitionBy("rec").orderBy("pos")))
    before, tag, kind = F.col("_b"), F.col("tag"), F.regexp_extract("tag", "^[BI]-(.*)$", 1)
    follows = F.coalesce(before.rlike("^[BI]-") & (F.regexp_extract(before, "^[BI]-(.*)$", 1) == kind), F.lit(False))
    unknown = F.when(~tag.isin(allowed), "unknown_label")
    shape = F.when(tag == "O", F.lit(None)).when(~tag.rlike("^[BI]-"), "invalid_bio_label").when(tag.startswith("I-") & ~follows, "illegal_i_without_b")
    return tags.select("rec", "pos", "tag", F.explode(F.array_compact(F.array(unknown, shape))).alias("error"))


def span_violations(spans: DataFrame) -> DataFrame:
    """spans (rec, text, start, end, value): every error of each, and one of each record whose spans overlap."""
    start, end, text = F.col("start"), F.col("end"), F.col("text")
    bounds = F.when(start.isNull() | end.isNull(), "span_bounds_not_int")
    outside = F.when((start < 0) | (end > F.length(text)), "span_out_of_range")
    empty = F.when(end <= start, "span_end_not_after_start")
    proper = (start >= 0) & (start < end) & (end <= F.length(text))
    value = F.when(proper & (F.substring(text, start + 1, end - start) != F.col("value")), "span_value_mismatch")
    own = spans.select("rec", "start", "end", F.explode(F.array_compact(F.array(bounds, outside, empty, value))).alias("error"))
    w = Window.partitionBy("rec").orderBy("start", "end")
    over = spans.where("start IS NOT NULL AND end IS NOT NULL").withColumn("_b", F.lag("end").over(w)).where("start < _b")
    first = over.groupBy("rec").agg(F.min(F.struct("start", "end")).alias("s")).select("rec", "s.start", "s.end", F.lit("overlapping_entities").alias("error"))
    return own.unionByName(first)


def malformed(records: DataFrame) -> DataFrame:
    """Rows without a text or label that can be used, with a preview."""
    error = F.when(F.col("text").isNull(), "MissingText").when(F.trim("text") == "", "EmptyText").when(F.col("raw_label").isNotNull() & F.col("label").isNull(), "InvalidSequenceLabel")
    return records.select("seq", error.alias("error"), F.substring(F.coalesce("text", F.lit("")), 1, 160).alias("preview")).where("error IS NOT NULL")


def manifest(files: DataFrame, blockers: int) -> DataFrame:
    """Where each file goes by its role; any blocker excludes all."""
    use = F.when(F.lit(blockers > 0), "EXCLUDED").when(F.col("role").like("MULTITASK_TRAIN%"), "TRAIN").when(F.col("role").like("MULTITASK_VALIDATION%"), "VALIDATION").when(F.col("protected"), "EVALUATION").otherwise("EXCLUDED")
    return files.withColumn("use", use)
