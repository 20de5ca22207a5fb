"""Leakage between files: overlap matrices, severities, and the projections of clean splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_matrix(records: DataFrame, key: str) -> DataFrame:
    """Per pair of files: how many copies they share; within a file, surplus copies."""
    counts = records.groupBy(F.col(key).alias("key"), "file").agg(F.count(F.lit(1)).alias("c"))
    a, b = (counts.select("key", F.col("file").alias(f"file_{s}"), F.col("c").alias(f"c_{s}")) for s in "ab")
    shared = F.when(F.col("file_a") == F.col("file_b"), F.col("c_a") - 1).otherwise(F.least("c_a", "c_b"))
    return a.join(b, "key").where("file_a <= file_b").groupBy("file_a", "file_b").agg(F.sum(shared).alias("shared")).where("shared > 0")


def group_overlap_matrix(records: DataFrame) -> DataFrame:
    """Per pair of different files: group ids that both have."""
    seen = records.where("group_id IS NOT NULL AND group_id <> ''").select("group_id", "file").distinct()
    a, b = (seen.select("group_id", F.col("file").alias(f"file_{s}")) for s in "ab")
    return a.join(b, "group_id").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("shared_groups"))


def affected_unique(records: DataFrame) -> DataFrame:
    """Per ordered pair of files: distinct texts of the first that the second holds."""
    seen = records.select("normalized_hash", "file").distinct()
    a, b = (seen.select("normalized_hash", F.col("file").alias(f"file_{s}")) for s in "ab")
    return a.join(b, "normalized_hash").where("file_a <> file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("affected"))


def role(split: Column, protected: Column) -> Column:
    return F.when(protected, "PROTECTED_EVALUATION").when(split == "train", "TRAIN_CANDIDATE").when(split == "validation", "VALIDATION_CANDIDATE").otherwise("HISTORICAL_OR_SUPERSEDED")


def severity(role_a: Column, role_b: Column, critical: Column) -> Column:
    """Of a pair of files by their roles."""
    has = lambda r: (role_a == r) | (role_b == r)
    train, protected = has("TRAIN_CANDIDATE"), has("PROTECTED_EVALUATION")
    return F.when(has("HISTORICAL_OR_SUPERSEDED"), "HISTORICAL_ONLY").when(train & protected, F.when(critical, "CRITICAL").otherwise("HIGH")).when(train & has("VALIDATION_CANDIDATE"), "MEDIUM").when(train, "LOW").when(protected, "HIGH").otherwise("LOW")


def blocks_build(level: Column, role_a: Column, role_b: Column, overlap: Column) -> Column:
    """Whether a pair stands in the way of clean splits: a training file that meets another role's."""
    train = (role_a == "TRAIN_CANDIDATE") | (role_b == "TRAIN_CANDIDATE")
    return (level != "HISTORICAL_ONLY") & train & (role_a != role_b) & overlap


def root_cause(same_file: Column, historical: Column, exact: Column, normal: Column, groups: Column) -> Column:
    return F.when(historical, "HISTORICAL_VERSION_OVERLAP").when(same_file, "SAME_FILE_DUPLICATES").when((groups > 0) & (normal == 0), "SAME_GROUP_SPLIT").when((groups > 0) & (normal > 0), "SAME_TEMPLATE_FAMILY").when(exact > 0, "EXACT_TEXT_COPY").when(normal > 0, "NORMALIZATION_ONLY").otherwise("UNKNOWN")


def pair_summary(records: DataFrame, roles: DataFrame) -> DataFrame:
    """The three matrices side by side with severity, blocker, cause and percentages. roles: file, role, critical, records."""
    both = ["file_a", "file_b"]
    exact = overlap_matrix(records, "exact_hash").withColumnRenamed("shared", "exact")
    normal = overlap_matrix(records, "normalized_hash").withColumnRenamed("shared", "normalized")
    joined = exact.join(normal, both, "fullouter").join(group_overlap_matrix(records), both, "fullouter").fillna(0, ["exact", "normalized", "shared_groups"])
    unique = affected_unique(records)
    of = lambda s: roles.select(*(F.col(c).alias(f"{c}_{s}") for c in ("file", "role", "critical")))
    named = joined.join(of("a"), "file_a").join(of("b"), "file_b").join(unique, both, "left").fillna(0, ["affected"])
    level = severity(F.col("role_a"), F.col("role_b"), F.col("critical_a") | F.col("critical_b"))
    historical = level == "HISTORICAL_ONLY"
    overlap = (F.col("exact") > 0) | (F.col("normalized") > 0) | (F.col("shared_groups") > 0)
    distinct = records.groupBy("file").agg(F.countDistinct("normalized_hash").alias("unique"))
    for s in "ab":
        named = named.join(distinct.select(F.col("file").alias(f"file_{s}"), F.col("unique").alias(f"unique_{s}")), f"file_{s}")
    share = lambda s: F.round(F.when(F.col(f"unique_{s}") > 0, F.lit(100.0) * F.col("affected") / F.col(f"unique_{s}")).otherwise(0.0), 4).alias(f"percentage_{s}")
    return named.select(*both, "role_a", "role_b", "exact", "normalized", "shared_groups", "unique_a", "unique_b", "affected", share("a"), share("b"), level.alias("severity"), blocks_build(level, F.col("role_a"), F.col("role_b"), overlap).alias("blocker"), root_cause(F.col("file_a") == F.col("file_b"), historical, F.col("exact"), F.col("normalized"), F.col("shared_groups")).alias("cause"))


def historical_summary(pairs: DataFrame) -> DataFrame:
    """One row: number and overlaps of the pairs that only concern historical files."""
    old = pairs.where("severity = 'HISTORICAL_ONLY'")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"historical_{c}")
    return old.agg(F.count(F.lit(1)).alias("historical_pairs"), total("exact"), total("normalized"), total("shared_groups"))


def cross_task_plan(records: DataFrame) -> DataFrame:
    """Per text and pair of a token and a sequence file: how their records can be planned for. records: normalized_hash,
    file, task, split, role (of role()), label."""
    side = lambda task, s: records.where(F.col("task") == task).groupBy("normalized_hash", "file").agg(*(F.min_by(c, "seq").alias(f"{c}_{s}") for c in ("split", "role", "label"))).withColumnRenamed("file", f"{task}_file")
    pairs = side("token", "t").join(side("sequence", "s"), "normalized_hash")
    meet = lambda a, b: ((F.col("role_t") == a) & (F.col("role_s") == b)) | ((F.col("role_s") == a) & (F.col("role_t") == b))
    same = F.col("split_t") == F.col("split_s")
    both = (F.col("label_t") == "LEAK") & (F.col("label_s") == "LEAK")
    kind = (
        F.when(meet("TRAIN_CANDIDATE", "PROTECTED_EVALUATION"), "SPLIT_CONFLICT").when(same & F.coalesce(both, F.lit(False)), "SAFE_BOTH_TASKS").when(same, "SAFE_SEPARATE_TASK_RECORDS")
        .when(meet("VALIDATION_CANDIDATE", "TRAIN_CANDIDATE"), "SPLIT_CONFLICT").otherwise("REVIEW_REQUIRED")
    )
    notes = {"SAFE_BOTH_TASKS": "One record can serve both tasks.", "SAFE_SEPARATE_TASK_RECORDS": "Keep a record for each task.", "SPLIT_CONFLICT": "The text stands in splits that must not meet.", "REVIEW_REQUIRED": "Look at it before splits are planned."}
    named = pairs.select("normalized_hash", "token_file", "sequence_file", kind.alias("classification"))
    return named.withColumn("notes", F.element_at(F.create_map(*(F.lit(x) for item in notes.items() for x in item)), F.col("classification")))


def projection_counters(strategy: str, kept: DataFrame, removed: DataFrame, validation: DataFrame | None = None) -> DataFrame:
    """One row of a projected split's counters. Records have normalized_hash, group_id, task, label, and may have
    entity_types (array<string>)."""
    group = F.coalesce(F.nullif("group_id", F.lit("")), F.col("normalized_hash"))
    entities = "entity_types" in kept.columns
    train = kept.agg(
        F.count(F.lit(1)).alias("train_records"), F.count_if(F.col("task") == "token").alias("token_train_records"), F.count_if(F.col("task") == "sequence").alias("sequence_train_records"),
        F.countDistinct(group).alias("train_groups"), F.count_if((F.col("task") == "sequence") & (F.col("label") == "LEAK")).alias("sequence_leaks"), F.count_if((F.col("task") == "sequence") & (F.col("label") == "NON_LEAK")).alias("sequence_non_leaks"),
        (F.coalesce(F.sum(F.when(F.col("task") == "token", F.size("entity_types"))), F.lit(0)) if entities else F.lit(0)).cast("long").alias("token_entities"),
    )
    gone = removed.agg(F.count(F.lit(1)).alias("removed_records"), F.countDistinct(F.nullif("group_id", F.lit(""))).alias("removed_groups"))
    held = (kept.where("false") if validation is None else validation).agg(F.count(F.lit(1)).alias("validation_records"), F.countDistinct(group).alias("validation_groups"))
    # Each side is one row.
    one = lambda d: d.withColumn("_one", F.lit(1))
    return one(train).join(one(gone), "_one").join(one(held), "_one").drop("_one").withColumn("strategy", F.lit(strategy))


def still_overlaps(kept: DataFrame, others: DataFrame) -> DataFrame:
    """One row: how many kept records still share a text or a group with the others (0 if a split is safe to build)."""
    by_text = kept.join(others.select("normalized_hash").distinct(), "normalized_hash", "left_semi").select("seq")
    named = others.where("group_id IS NOT NULL AND group_id <> ''").select("group_id").distinct()
    by_group = kept.join(named, "group_id", "left_semi").select("seq")
    return by_text.unionByName(by_group).agg(F.countDistinct("seq").alias("overlaps")).withColumn("safe", F.col("overlaps") == 0)


def protected_overlap(records: DataFrame) -> DataFrame:
    """Training rows that meet protected rows by text or by group, distinct by files, training hash and kind."""
    train, other = records.where("split = 'train' AND NOT protected"), records.where("protected")
    parts = []
    for key, kind in (("normalized_hash", "NORMALIZED_TEXT"), ("group_id", "GROUP_ID")):
        a = train.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("key"), F.col("file").alias("train_file"), F.col("normalized_hash").alias("hash")).distinct()
        b = other.select(F.col(key).alias("key"), F.col("file").alias("protected_file")).distinct()
        parts.append(a.join(b, "key").select("train_file", "protected_file", "hash", F.lit(kind).alias("overlap_type")).distinct())
    return parts[0].unionByName(parts[1])


def without(records: DataFrame, *others: DataFrame) -> DataFrame:
    """Records that share neither text nor group with the others; missing groups never match."""
    for o in others:
        records = records.join(o.select("normalized_hash").distinct(), "normalized_hash", "left_anti")
        groups = o.where("group_id IS NOT NULL AND group_id <> ''").select("group_id").distinct()
        records = records.join(groups, "group_id", "left_anti")
    return records


def option_a(records: DataFrame) -> DataFrame:
    """The training rows that stay next to validation and protected rows."""
    return without(records.where("split = 'train' AND NOT protected"), records.where("split = 'validation' AND NOT protected"), records.where("protected"))


def option_b(records: DataFrame, every: int = 5) -> DataFrame:
    """Training and validation rows pooled, cleaned and dealt anew: each `every`-th key in order goes to validation.

    Keys are numbered by counts per range of the sorted key, not by one window over all of them.
    """
    pool = without(records.where("split IN ('train', 'validation') AND NOT protected"), records.where("protected"))
    keyed = pool.withColumn("bucket", F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("normalized_hash")))
    keys = number_sorted(keyed.select("bucket").distinct(), "bucket")
    return keyed.join(keys, "bucket").withColumn("new_split", F.when(F.col("position") % every == 0, "validation").otherwise("train"))


#: Ranges that sorted keys are cut into.
RANGES = 256


def number_sorted(keys: DataFrame, col: str) -> DataFrame:
    """Distinct keys with their position in the whole order: ranges are counted, then numbered each for itself.

    The ranges end at keys that a hash picks (RANGES at most), so they are of about equal size whatever keys share.
    """
    picked = [r[0] for r in keys.select(col).orderBy(F.xxhash64(col), col).limit(RANGES).collect()]
    ends = F.array(*map(F.lit, picked)).cast("array<string>")
    ranged = keys.select(col).withColumn("_part", F.size(F.filter(ends, lambda b: b <= F.col(col))))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # RANGES + 1 rows at most
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1
    return ranged.withColumn("_rank", rank).join(F.broadcast(before), "_part").select(col, (F.col("_before") + F.col("_rank")).alias("position"))


def recommended(a: Column, b: Column) -> Column:
    """A if it keeps enough rows in comparison with B."""
    return F.when(a >= F.greatest(F.lit(100), F.floor(b / 2)), "OPTION_A").otherwise("OPTION_B")
