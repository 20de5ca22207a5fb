"""Rule and model evidence to a label, a risk level and a confidence, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of evidence sources.
REGEX, SEQUENCE, TOKENS = "regex", "model_sequence", "model_token_localization"
RULE_CONFIDENCE = 0.99


def finite(c: Column) -> Column:
    """A number, or one from numeric text; null for booleans' text, NaN and infinities."""
    v = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def sequence_validity(status: Column, label: Column, prediction: Column, probability: Column, threshold: Column) -> Column:
    """ERROR, NOT_RUN, INVALID_RESULT, VALID_LEAK or VALID_NON_LEAK."""
    p, t, y = finite(probability), finite(threshold), finite(prediction).cast("int")
    usable = y.isin(0, 1) & p.between(0, 1) & t.between(0, 1)
    return (
        F.when(status == "ERROR", "ERROR").when(F.coalesce(status, F.lit("")) != "OK", "NOT_RUN")
        .when(usable & (label == "LEAK") & (y == 1) & (p >= t), "VALID_LEAK")
        .when(usable & (label == "NON_LEAK") & (y == 0) & (p < t), "VALID_NON_LEAK")
        .otherwise("INVALID_RESULT")
    )


def decision(has_regex: Column, validity: Column, confidence: Column, has_tokens: Column, status: Column, has_errors: Column) -> Column:
    """The fused decision as a struct."""
    leak, safe = validity == "VALID_LEAK", validity == "VALID_NON_LEAK"
    label = F.when(has_regex | leak, "LEAK").when(safe, "NON_LEAK").otherwise("UNDETERMINED")
    risk = F.when(has_regex & leak, "HIGH").when(has_regex | leak, "MEDIUM").when(safe, "LOW").otherwise("UNKNOWN")
    source = F.when(leak, SEQUENCE).when(has_regex, "regex_deterministic").when(safe, SEQUENCE).otherwise("none")
    value = F.when(leak, confidence).when(has_regex, F.lit(RULE_CONFIDENCE)).when(safe, confidence)
    effective = F.when(label == "UNDETERMINED", "FAILED").when(has_errors & (status == "COMPLETE"), "PARTIAL").otherwise(status)
    evidence = F.array_compact(F.array(F.when(has_regex, REGEX), F.when(leak, SEQUENCE), F.when(has_tokens, TOKENS)))
    reasons = F.array_compact(
        F.array(
            F.when(has_regex, "A pattern found a structured sensitive value."),
            F.when(leak, "The sequence model calls the text a leak."),
            F.when(has_tokens, "The token model marked spans."),
            F.when((label == "NON_LEAK") & has_tokens, "Marked spans alone don't make a leak."),
            F.when((label == "NON_LEAK") & ~has_tokens, "Neither patterns nor the sequence model found a leak."),
            F.when(label == "UNDETERMINED", "There is no valid model result and no pattern matched."),
        )
    )
    return F.struct(label.alias("final_label"), risk.alias("risk_level"), value.alias("confidence_value"), source.alias("confidence_source"), reasons.alias("reasons"), evidence.alias("evidence_sources"), effective.alias("analysis_status"))


def types_of(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda f: f["type"])))


def max_score(scores: Column) -> Column:
    return F.array_max(F.filter(F.transform(scores, finite), lambda s: s.between(0, 1)))


def merge_errors(*errors: Column) -> Column:
    """First occurrences in order, by all four fields."""
    return F.array_distinct(F.concat(*(F.coalesce(e, F.array()) for e in errors)))


def summarise(units: DataFrame, keys: list[str]) -> DataFrame:
    """Counters per document from unit rows (final_label, risk_level, analysis_status); unknown values count as
    undetermined, unknown and failed."""
    count = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    label, risk, status = F.col("final_label"), F.col("risk_level"), F.col("analysis_status")
    here = F.col("unit_no").isNotNull()
    known = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    return units.groupBy(*keys).agg(
        count(here, "total"), count(label == "LEAK", "leaks"), count(label == "NON_LEAK", "non_leaks"), count(here & ~known(label, "LEAK", "NON_LEAK"), "undetermined"),
        count(risk == "HIGH", "high"), count(risk == "MEDIUM", "medium"), count(risk == "LOW", "low"), count(here & ~known(risk, "HIGH", "MEDIUM", "LOW"), "unknown"),
        count(status == "COMPLETE", "complete"), count(status == "PARTIAL", "partial"), count(here & ~known(status, "COMPLETE", "PARTIAL"), "failed"),
    )


def counters() -> list[Column]:
    """The counters of a results document, from unit rows with an errors column."""
    count = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    label, risk, status = F.col("final_label"), F.col("risk_level"), F.col("analysis_status")
    other = lambda c, *v: ~F.coalesce(c.isin(*v), F.lit(False))
    return [
        F.count(F.lit(1)).alias("total_sentences"), count(label == "LEAK", "total_leaks"), count(label == "NON_LEAK", "total_non_leaks"), count(other(label, "LEAK", "NON_LEAK"), "total_undetermined"),
        count(risk == "HIGH", "high_risk"), count(risk == "MEDIUM", "medium_risk"), count(risk == "LOW", "low_risk"), count(other(risk, "HIGH", "MEDIUM", "LOW"), "unknown_risk"),
        count(status == "COMPLETE", "complete_analyses"), count(status == "PARTIAL", "partial_analyses"), count(other(status, "COMPLETE", "PARTIAL"), "failed_analyses"),
        F.sum(F.size("errors")).cast("long").alias("model_errors_count"),
    ]


def sequence_support() -> Column:
    """What the sequence result gave to the decision, from a judged unit's columns."""
    used = F.coalesce(F.col("validity") == "VALID_LEAK", F.lit(False))
    y, p, t = finite(F.col("prediction")).cast("int"), finite(F.col("probability")), finite(F.col("threshold"))
    return F.struct(
        F.coalesce("status", F.lit("NOT_RUN")).alias("status"), "validity", "label", F.when(y.isin(0, 1), y).alias("prediction"), "confidence", F.when(p.between(0, 1), p).alias("probability_leak"), "temperature",
        F.when(t.between(0, 1), t).alias("threshold"), F.col("scored_by").alias("source"), used.alias("used_for_final_label"), used.alias("used_for_risk_level"),
    )


def token_support() -> Column:
    """What the marked spans gave: they locate values and never decide."""
    marked = F.coalesce((F.col("status") == "OK") & (F.size("tokens") > 0), F.lit(False))
    scores = max_score(F.transform("tokens", lambda t: t["score"].cast("string")))
    return F.struct(F.coalesce("status", F.lit("NOT_RUN")).alias("status"), F.size("tokens").alias("span_count"), scores.alias("max_score"), F.lit(False).alias("used_for_final_label"), marked.alias("used_for_localization"))


def document_status(total: Column, complete: Column, failed: Column) -> Column:
    return F.when(total == 0, "COMPLETE").when(failed == total, "FAILED").when(complete == total, "COMPLETE").otherwise("PARTIAL")


def first_metadata() -> Column:
    """An aggregate: the first valid (temperature, threshold) in unit order, null where there is none."""
    t, h = finite(F.col("temperature").cast("string")), finite(F.col("threshold").cast("string"))
    valid = (F.col("status") == "OK") & F.col("validity").isin("VALID_LEAK", "VALID_NON_LEAK") & (t > 0) & h.between(0, 1)
    pair = F.min_by(F.struct(t.alias("temperature"), h.alias("threshold")), F.when(valid, F.col("unit_no")))
    return F.when(F.count_if(valid) > 0, pair)


def first_valid_metadata(units: DataFrame, keys: list[str]) -> DataFrame:
    """The first valid (temperature, threshold) in unit order; null where a document has none."""
    return units.groupBy(*keys).agg(first_metadata().alias("_m")).select(*keys, "_m.temperature", "_m.threshold")
