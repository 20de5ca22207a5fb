"""Clean dataset construction and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.text import binary_label, group_key, normalize_key, stable_hash
from textwarden.operators.leakage import number_sorted


def keep_first(records: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first record of each key: a min over a struct, so copies are folded before the shuffle."""
    rest = [c for c in records.columns if c not in (*keys, order)]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(order)).select(*keys, order, "_r.*")


def token_payload(records: DataFrame) -> DataFrame:
    """Adds a column payload (tokens, ner_tags, tag_names, typed_spans); lists of different lengths raise."""
    same = F.col("tokens").isNotNull() & F.col("ner_tags").isNotNull() & (F.size("tokens") == F.size("ner_tags")) & (F.col("tag_names").isNull() | (F.size("tag_names") == F.size("tokens")))
    payload = F.struct("tokens", "ner_tags", "tag_names", "typed_spans")
    return records.withColumn("payload", F.when(F.coalesce(same, F.lit(False)), payload).otherwise(F.raise_error(F.lit("the lists of a token record don't fit")).cast(records.select(payload.alias("p")).schema["p"].dataType)))


def canonical_records(records: DataFrame, task: str, split: str, source: str, order: str = "seq") -> DataFrame:
    """Records of one file in the form in which datasets are written: id (split, task and a running number from the
    order), text, normalized_hash, task, split, sequence_label, group_id, category, source_dataset, source_id, payload."""
    have = lambda c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
    label = binary_label("build", F.coalesce(*map(have, ("sequence_label", "document_label", "label", "label_name"))))
    rows = token_payload(records) if task in ("token", "both") else records.withColumn("payload", F.lit(None))
    width = F.lpad(F.col("position").cast("string"), 7, "0")
    keys = number_sorted(records.select(F.lpad(F.col(order).cast("string"), 20, "0").alias("_key")), "_key")
    numbered = rows.withColumn("_key", F.lpad(F.col(order).cast("string"), 20, "0")).join(keys, "_key")
    return numbered.select(
        F.concat(F.lit(f"{split}_{task}_"), width).alias("id"), "text", stable_hash(normalize_key(F.col("text"))).alias("normalized_hash"), F.lit(task).alias("task"), F.lit(split).alias("split"),
        F.when(label == "LEAK", 1).when(label == "NON_LEAK", 0).alias("sequence_label"), group_key("build", records.columns).alias("group_id"), have("category").alias("category"),
        F.lit(source).alias("source_dataset"), F.coalesce(have("id"), have("case_id")).alias("source_id"), "payload",
    )


def distribution(records: DataFrame) -> DataFrame:
    """One row: records, maps of tasks, labels and entity types (of tag_names), and the least, largest and mean length."""
    counted = lambda rows, name: rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))
    label = F.when(F.col("sequence_label") == 1, "LEAK").when(F.col("sequence_label") == 0, "NON_LEAK").otherwise("MISSING")
    tags = records.select(F.explode("tag_names").alias("t")).where("t <> 'O'").select(F.regexp_replace("t", "^[BI]-", "").alias("v"))
    size = F.length("text")
    least = lambda f, n: F.coalesce(f(size), F.lit(0)).alias(n)
    out = records.agg(F.count(F.lit(1)).alias("records"), least(F.min, "min_length"), least(F.max, "max_length"), least(F.avg, "mean_length"))
    for rows, name in ((records.select(F.col("task").alias("v")), "tasks"), (records.select(label.alias("v")), "sequence_labels"), (tags, "entity_types")):
        out = out.withColumn("_one", F.lit(1)).join(counted(rows, name).withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return out


def merge_same_text(tokens: DataFrame, sequences: DataFrame) -> DataFrame:
    """Token and sequence records of equal text and label, paired one to one in order, become task `both`."""
    w = Window.partitionBy("normalized_hash", "label").orderBy("seq")
    side = lambda d, name: d.select("normalized_hash", "label", F.col("seq").alias(name), F.row_number().over(w).alias("k"))
    joined = side(tokens, "token_seq").join(side(sequences, "sequence_seq"), ["normalized_hash", "label", "k"], "fullouter")
    task = F.when(F.col("token_seq").isNull(), "sequence").when(F.col("sequence_seq").isNull(), "token").otherwise("both")
    return joined.select("normalized_hash", "label", "token_seq", "sequence_seq", task.alias("task"))


def split_isolation(parts: dict[str, DataFrame]) -> DataFrame:
    """For each pair of parts: hashes and groups that both have (all must be 0)."""
    names, out = list(parts), None
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            for col in ("normalized_hash", "group_id"):
                a, b = (parts[n].where(F.col(col).isNotNull()).select(col) for n in (x, y))
                row = a.intersect(b).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(f"{x}-{y}:{col}").alias("check"), "shared")
                out = row if out is None else out.unionByName(row)
    return out


def assert_isolated(parts: dict[str, DataFrame]) -> None:
    """Raises if two parts share a text or a group."""
    bad = split_isolation(parts).where("shared > 0").collect()
    if bad:
        raise ValueError("splits aren't disjoint: " + ", ".join(f"{r.check} ({r.shared})" for r in bad))


def is_hard(flag: Column) -> Column:
    """A record counts as hard only if the flag says explicitly that it wasn't copied from a blind set."""
    return F.coalesce(F.lower(flag.cast("string")) == "false", F.lit(False))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """The rows in an order of their own for each epoch."""
    return rows.orderBy(dice(seed + epoch, F.col(key)))


def dice(seed: int, key: Column) -> Column:
    """A deterministic shuffle order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def deterministic_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    return rows.orderBy(dice(seed, F.col(key))).limit(size)


def stratified_sample(rows: DataFrame, key: str, hard: Column, size: int, hard_share: float, seed: int) -> DataFrame:
    """Hard and other rows by quota; a kind that falls short is filled up from the other. Two bounded top-k's, no window."""
    quota = round(size * hard_share)
    marked = rows.withColumns({"hard": F.coalesce(hard, F.lit(False)), "_dice": dice(seed, F.col(key))})
    top = lambda want: marked.where(F.col("hard") == want).orderBy("_dice").limit(size)
    both = top(True).unionByName(top(False))  # at most twice the sample's size
    ranked = both.withColumn("_rank", F.row_number().over(Window.partitionBy("hard").orderBy("_dice")))
    over = F.when(F.col("hard"), F.col("_rank") > quota).otherwise(F.col("_rank") > size - quota)
    return ranked.orderBy(over, "_dice").limit(size).drop("_rank", "_dice")


def sampling_weights(rows: DataFrame, hard: Column, ratio: float) -> DataFrame:
    """Weights that give hard rows the share `ratio` of the mass."""
    marked = rows.withColumn("hard", F.coalesce(hard, F.lit(False)))
    sizes = marked.groupBy("hard").agg(F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("hard"), F.lit(ratio)).otherwise(F.lit(1.0 - ratio))
    return marked.join(F.broadcast(sizes), "hard").withColumn("weight", share / F.col("_n")).drop("_n")


def optimizer_updates(batches: Column, accumulation: int) -> Column:
    return F.ceil(batches / F.lit(accumulation)).cast("long")


def updates_here(batch: Column, batches: Column, accumulation: int) -> Column:
    """Whether an update follows a batch (from 1): after each full accumulation and after the last batch."""
    return (batch % F.lit(accumulation) == 0) | (batch == batches)


def schema_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """What two label schemas (label_id, label) don't share: side, label_id, label."""
    columns = ["label_id", "label"]
    only = lambda a, b, side: a.select(columns).exceptAll(b.select(columns)).select(F.lit(side).alias("side"), *columns)
    return only(left, right, "missing").unionByName(only(right, left, "unexpected"))
