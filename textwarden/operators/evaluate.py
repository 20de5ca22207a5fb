"""Classifier evaluation and calibration as group-bys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

D = "double"


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast(D), b.cast(D)), F.lit(0.0))


def confusion(label: Column, predicted: Column) -> list[Column]:
    cell = lambda y, p, name: F.count_if((label == y) & (predicted == p)).alias(name)
    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Adds the metrics of a table with tn, fp, fn and tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    one_class = (tp + fn == 0) | (tn + fp == 0)
    balanced = F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / F.lit(2.0))
    wide = [x.cast(D) for x in (tp + fp, tp + fn, tn + fp, tn + fn)]
    mcc = F.when(one_class, F.lit(0.0)).otherwise(ratio(tp.cast(D) * tn - fp.cast(D) * fn, F.sqrt(wide[0] * wide[1]) * F.sqrt(wide[2] * wide[3])))
    named = {"samples": tn + fp + fn + tp, "accuracy": ratio(tp + tn, tn + fp + fn + tp), "balanced_accuracy": balanced, "precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(tp * 2, tp * 2 + fp + fn), "specificity": specificity, "mcc": mcc, "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)}
    return counts.select("*", *((c if n == "samples" else F.round(c, digits)).alias(n) for n, c in named.items()))


def binary_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scored: label and prediction (0 or 1)."""
    return rates(scored.groupBy(*(by or [])).agg(*confusion(F.col("label"), F.col("prediction"))))


def _by_score(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows per distinct score, so windows run over scores, not rows."""
    return scored.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


def roc_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mann-Whitney with ties counted half; null where a class is missing."""
    w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = _by_score(scored, by).withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0)))
    wins = F.sum(F.col("pos").cast(D) * (F.col("below") + (F.col("n") - F.col("pos")) / F.lit(2.0)))
    return s.groupBy(*by).agg(F.round(F.try_divide(wins, F.sum("pos").cast(D) * F.sum(F.col("n") - F.col("pos"))), 6).alias("roc_auc"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    s = _by_score(scored, by).withColumn("precision", F.sum("pos").over(w) / F.sum("n").over(w).cast(D))
    return s.groupBy(*by).agg(F.round(ratio(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")), 6).alias("average_precision"))


def token_micro(tokens: DataFrame) -> DataFrame:
    """gold and predicted ids, 0 is outside: a wrong type counts as both a false positive and a false negative."""
    g, p = F.col("gold"), F.col("predicted")
    counts = tokens.agg(F.count_if((g != 0) & (g == p)).alias("tp"), F.count_if((p != 0) & (g != p)).alias("fp"), F.count_if((g != 0) & (g != p)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(tp * 2, tp * 2 + fp + fn), 6).alias("f1"))


def per_type(tokens: DataFrame, schema: DataFrame) -> DataFrame:
    """One against the rest for every type of the schema (label_id, entity_type), those that don't occur included."""
    g = schema.select(F.col("label_id").alias("gold"), F.col("entity_type").alias("gt"))
    p = schema.select(F.col("label_id").alias("predicted"), F.col("entity_type").alias("pt"))
    named = tokens.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n")).join(g, "gold", "left").join(p, "predicted", "left")
    n = F.col("n")
    one = lambda c, cond, name: named.where(cond & F.col(c).isNotNull()).groupBy(F.col(c).alias("entity_type")).agg(F.sum(n).alias(name))
    same = F.coalesce(F.col("gt") == F.col("pt"), F.lit(False))
    out = schema.where("entity_type IS NOT NULL").select("entity_type").distinct()
    for c, cond, name in (("gt", same, "tp"), ("pt", ~same, "fp"), ("gt", ~same, "fn")):
        out = out.join(one(c, cond, name), "entity_type", "left")
    out = out.fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("entity_type", "tp", "fp", "fn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(tp * 2, tp * 2 + fp + fn), 6).alias("f1"))


def calibrated(z0: Column, z1: Column, temperature: float) -> Column:
    """The leak probability of two logits at a temperature."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((z0 - z1) / F.lit(float(temperature))))


def temperature_grid(logits: DataFrame, grid: list[float]) -> DataFrame:
    """Mean cross entropy at each temperature; the grid is exploded in the row, not joined."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in grid)))
    margin = F.when(F.col("label") == 1, F.col("z0") - F.col("z1")).otherwise(F.col("z1") - F.col("z0"))
    return logits.select(margin.alias("m"), t.alias("temperature")).groupBy("temperature").agg(F.round(F.avg(F.log1p(F.exp(F.col("m") / F.col("temperature")))), 6).alias("nll"))


def fit_temperature(logits: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 25, rounds: int = 4) -> float:
    """Grid search that narrows around the best temperature: one job each round."""
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
        best = temperature_grid(logits, grid).orderBy("nll", "temperature").first()
        if best is None or best[0] is None:
            return 1.0
        k = min(range(steps), key=lambda i: abs(grid[i] - best[0]))
        low, high = grid[max(0, k - 1)], grid[min(steps - 1, k + 1)]
    return float(best[0])


def threshold_sweep(scored: DataFrame, steps: int = 100) -> DataFrame:
    """Metrics at 0.01 to 0.99. Scores fall into the count of thresholds that they reach, so rows are folded to 100 bins
    before any threshold is looked at."""
    least, step = F.least(F.greatest(F.floor(F.col("score") * F.lit(steps)), F.lit(0)), F.lit(steps - 1)), lambda i: i / F.lit(float(steps))
    # The product may be off by one step either way, which one comparison on each side tells.
    reached = F.when((F.col("_b") < steps - 1) & (F.col("score") >= step(F.col("_b") + 1)), F.col("_b") + 1).when((F.col("_b") > 0) & (F.col("score") < step(F.col("_b"))), F.col("_b") - 1).otherwise(F.col("_b"))
    bins = scored.withColumn("_b", least).groupBy(reached.cast("int").alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))
    at = bins.select("label", "n", "bin", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("i"))
    hit = F.col("bin") >= F.col("i")
    cell = lambda y, p, name: F.coalesce(F.sum(F.when((F.col("label") == y) & (hit if p else ~hit), F.col("n"))), F.lit(0)).alias(name)
    counts = at.groupBy("i").agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return rates(counts.select((F.col("i") / F.lit(float(steps))).alias("threshold"), "tn", "fp", "fn", "tp"))


def choose_threshold(sweep: DataFrame, min_recall: float, max_fpr: float) -> DataFrame:
    """The best threshold by the strictest rule that any threshold meets; ties go to the lowest."""
    recall, fpr = F.col("recall") >= min_recall, F.col("fpr") <= max_fpr
    rank = F.when(recall & fpr, 0).when(recall, 1).otherwise(2)
    pick = lambda a, b, c: F.when(rank == 0, a).when(rank == 1, b).otherwise(c)
    f1, pr, sp, rc = (F.col(c) for c in ("f1", "precision", "specificity", "recall"))
    order = [rank, F.desc("f1"), pick(pr, -F.col("fpr"), rc).desc(), pick(sp, pr, -F.col("fpr")).desc(), "threshold"]
    rule = F.when(rank == 0, "STRICT_RECALL_AND_FPR").when(rank == 1, "RECALL_ONLY_FALLBACK").otherwise("BEST_F1_FALLBACK")
    return sweep.withColumn("rule", rule).orderBy(*order).limit(1).select("threshold", "rule", f1, pr, rc, sp)


def calibration_record(logits: DataFrame, model: str, selection_set: str, min_recall: float, max_fpr: float) -> tuple[DataFrame, DataFrame]:
    """(record, sweep) of logits (z0, z1, label): the fitted temperature, the chosen threshold with its rule, the targets,
    and the metrics at that threshold."""
    temperature = fit_temperature(logits)
    scored = logits.select("label", calibrated(F.col("z0"), F.col("z1"), temperature).alias("score"))
    sweep = threshold_sweep(scored)
    chosen = choose_threshold(sweep, min_recall, max_fpr).select("threshold", "rule")
    named = {"model": model, "temperature": temperature, "selection_set": selection_set, "minimum_recall": min_recall, "maximum_fpr_target": max_fpr}
    return sweep.join(F.broadcast(chosen), "threshold").withColumns({k: F.lit(v) for k, v in named.items()}).withColumnRenamed("rule", "selection_rule"), sweep  # chosen is one row


def evaluate_scorer(units: DataFrame, scorer: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, errors) of a scorer on units (sentence, label 0 or 1): binary_metrics() of what it scored, by keys, and
    the rows that it got wrong. Rows without a result count as errors, not in the metrics."""
    gold = units.withColumnRenamed("label", "gold")
    scored = scorer(gold).withColumns({"label_name": F.col("label"), "label": F.col("gold")})
    usable = scored.where("status = 'OK'").withColumn("score", F.col("probability"))
    return binary_metrics(usable, keys or []), scored.where("status <> 'OK' OR prediction <> gold")


def row_errors(tokens: DataFrame) -> DataFrame:
    """row_index and errors of the rows with a wrong token (gold, predicted, row_index)."""
    return tokens.groupBy("row_index").agg(F.count_if(F.col("gold") != F.col("predicted")).alias("errors")).where("errors > 0")


def mean_score(token_f1: Column, sequence_f1: Column) -> Column:
    """The score of a checkpoint by both heads alike."""
    return 0.5 * token_f1 + 0.5 * sequence_f1


def selection_score(token_f1: Column, hard_token_f1: Column, sequence_f1: Column, hard_sequence_f1: Column, failed: Column) -> Column:
    return 0.3 * token_f1 + 0.3 * hard_token_f1 + 0.2 * sequence_f1 + 0.2 * hard_sequence_f1 - 0.1 * failed


def rankings(metrics: DataFrame) -> DataFrame:
    """task, model, f1 per dataset to mean F1 and rank."""
    mean = metrics.groupBy("task", "model").agg(F.round(F.avg("f1"), 6).alias("mean_f1"))
    return mean.withColumn("rank", F.rank().over(Window.partitionBy("task").orderBy(F.desc("mean_f1"))))


def merge_spans(tokens: DataFrame, least: float = 0.55) -> DataFrame:
    """tokens (text, pos, tag, score, start, end) to spans: neighbours of one type with white space between merge."""
    kept = tokens.where((F.col("tag") != "O") & (F.col("score") >= least) & (F.col("end") > F.col("start"))).withColumn("type", F.regexp_replace("tag", "^[BI]-", ""))
    w = Window.partitionBy("text").orderBy("pos")
    near = (F.lag("type").over(w) == F.col("type")) & (F.lag("pos").over(w) == F.col("pos") - 1) & (F.col("start") <= F.lag("end").over(w) + 1)
    gap = F.substring(F.col("text"), F.lag("end").over(w) + 1, F.greatest(F.lit(0), F.col("start") - F.lag("end").over(w)))
    runs = kept.withColumn("_run", F.sum(F.when(F.coalesce(near & (F.trim(gap) == ""), F.lit(False)), 0).otherwise(1)).over(w))
    spans = runs.groupBy("text", "_run").agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.avg("score"), 4).alias("score"))
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.select("text", "type", "start", "end", "score", value.alias("value")).where(F.trim("value") != "")


def align_subtokens(words: DataFrame) -> DataFrame:
    """rec, pos, word_id, label: the first piece of a word keeps its label, the others get -100."""
    before = F.lag("word_id").over(Window.partitionBy("rec").orderBy("pos"))
    return words.withColumn("aligned", F.when(F.col("word_id").isNull() | (before == F.col("word_id")), -100).otherwise(F.col("label")))


def top_k(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)
