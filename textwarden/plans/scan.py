"""The document scan as one lazy plan: page text, units, findings, model scores, decisions, summaries, results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.patterns import findings, matches
from textwarden.operators import decide
from textwarden.operators.segment import text_units

TOKENS = "array<struct<type:string,value:string,start:int,end:int,score:double>>"
ERRORS = "array<struct<component:string,source:string,error_type:string,message:string>>"
#: What a scorer adds to units: the sequence result, marked spans, and errors.
SCORED = {
    "status": "string", "label": "string", "prediction": "int", "confidence": "double", "probability": "double", "threshold": "double", "temperature": "double", "scored_by": "string",
    "tokens": TOKENS, "errors": ERRORS,
}
TEMPERATURE, THRESHOLD, TOKEN_THRESHOLD = 2.8146126944056307, 0.169112, 0.55
SCHEMA_VERSION, PIPELINE = "2.0", "textwarden"
Scorer = Callable[[DataFrame], DataFrame]


def _number(name: str, value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError(f"{name} must be a number")
    number = float(value)
    if not math.isfinite(number):
        raise ValueError(f"{name} must be finite")
    return number


def checked_settings(temperature: object = TEMPERATURE, threshold: object = THRESHOLD, token_threshold: object = TOKEN_THRESHOLD) -> tuple[float, float, float]:
    """Temperature above 0, threshold between 0 and 1, token threshold from 0 to 1; truth values are no numbers."""
    t, h, k = _number("temperature", temperature), _number("threshold", threshold), _number("token_threshold", token_threshold)
    if t <= 0:
        raise ValueError("temperature must be above 0")
    if not 0 < h < 1:
        raise ValueError("threshold must lie between 0 and 1")
    if not 0 <= k <= 1:
        raise ValueError("token_threshold must lie from 0 to 1")
    return t, h, k


def null_scorer(units: DataFrame) -> DataFrame:
    """No model: every unit is NOT_RUN."""
    fixed = {"status": F.lit("NOT_RUN"), "tokens": F.array(), "errors": F.array()}
    return units.select("*", *(fixed.get(c, F.lit(None)).cast(t).alias(c) for c, t in SCORED.items()))


def rule_scorer(units: DataFrame, temperature: float = TEMPERATURE, threshold: float = THRESHOLD) -> DataFrame:
    """A deterministic stand-in for a trained model, for tests of what comes behind it: the logit margin is the number of
    findings and of digits in ten characters, and marked spans are runs of five digits or more."""
    temperature, threshold, _ = checked_settings(temperature, threshold)
    digits = F.length("sentence") - F.length(F.regexp_replace("sentence", "[0-9]", ""))
    margin = F.size("findings") * F.lit(4.0) + F.lit(10.0) * digits / F.length("sentence") - F.lit(5.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin / F.lit(temperature)))
    spans = F.transform(matches(F.col("sentence"), "[0-9]{5,}", "NUMBER"), lambda f: F.struct(f["type"].alias("type"), f["value"].alias("value"), f["start"].alias("start"), f["end"].alias("end"), F.lit(0.9).alias("score")))
    scored = units.withColumn("probability", p)
    leak = F.col("probability") >= F.lit(threshold)
    made = {
        "status": F.lit("OK"), "label": F.when(leak, "LEAK").otherwise("NON_LEAK"), "prediction": leak, "confidence": F.round(F.when(leak, F.col("probability")).otherwise(1 - F.col("probability")), 6),
        "probability": F.col("probability"), "threshold": F.lit(threshold), "temperature": F.lit(temperature), "scored_by": F.lit("rule"), "tokens": spans, "errors": F.array(),
    }
    return scored.select(*units.columns, *(made[c].cast(t).alias(c) for c, t in SCORED.items()))


#: Models by name, loaded once in a worker.
_LOADED: dict[str, Callable] = {}


def python_scorer(load: Callable[[], Callable[[list[str]], list[tuple]]], temperature: float = TEMPERATURE, threshold: float = THRESHOLD, name: str | None = None) -> Scorer:
    """A scorer around a model: load() returns a function from texts to their logits (z0, z1), or (z0, z1, spans) with
    spans as tuples (type, value, start, end, score). It runs once a worker under a name, once a task without one. A
    batch that fails becomes ERROR rows with the error; the task goes on."""
    temperature, threshold, _ = checked_settings(temperature, threshold)
    source = name or "model"

    def scorer(units: DataFrame) -> DataFrame:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema), *(f"{c} {t}" for c, t in SCORED.items())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _LOADED.get(name) if name else None
            for pdf in batches:
                try:
                    if model is None:
                        model = load()
                        if name:
                            _LOADED[name] = model
                    rows = []
                    for z0, z1, *spans in model(pdf["sentence"].tolist()):
                        p = 1 / (1 + math.exp(max(-700.0, min(700.0, (z0 - z1) / temperature))))
                        leak = p >= threshold
                        rows.append(("OK", "LEAK" if leak else "NON_LEAK", int(leak), round(p if leak else 1 - p, 6), round(p, 6), threshold, temperature, source, [dict(zip(("type", "value", "start", "end", "score"), s, strict=True)) for s in (spans[0] if spans else [])], []))
                    if len(rows) != len(pdf):
                        raise ValueError("the model must return a result for each text")
                except Exception as error:
                    told = [{"component": "model", "source": source, "error_type": type(error).__name__, "message": str(error)}]
                    rows = [("ERROR", None, None, None, None, None, None, source, [], told)] * len(pdf)
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=list(SCORED)).astype({"prediction": "Int32"})], axis=1)

        return units.mapInPandas(run, schema)

    return scorer


def scan_units(pages: DataFrame, keys: list[str], scorer: Scorer = null_scorer, text: str = "text") -> DataFrame:
    """keys, unit_no, sentence, findings, the scorer's columns, validity and the decision's columns."""
    found = text_units(pages, keys, text).withColumn("findings", findings(F.col("sentence")))
    validity = decide.sequence_validity(*(F.col(c) for c in ("status", "label", "prediction", "probability", "threshold")))
    judged = scorer(found).withColumn("validity", validity)
    marked = (F.col("status") == "OK") & (F.size("tokens") > 0)
    failed = F.col("status") == "ERROR"
    fused = decide.decision(F.size("findings") > 0, F.col("validity"), F.col("confidence"), F.coalesce(marked, F.lit(False)), F.when(failed, "FAILED").otherwise("COMPLETE"), failed | (F.size("errors") > 0))
    judged = judged.withColumn("decision", fused).select("*", "decision.*").drop("decision")
    return judged.withColumns({"sequence_support": decide.sequence_support(), "token_support": decide.token_support()})


def document_summary(pages: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Counters and status for every page, those without units included."""
    counted = decide.summarise(units, keys)
    counters = [c for c in counted.columns if c not in keys]
    full = pages.select(*keys).distinct().join(counted, keys, "left").fillna(0, counters)
    return full.withColumn("document_status", decide.document_status(F.col("total"), F.col("complete"), F.col("failed")))


def scan_documents(pages: DataFrame, keys: list[str], scorer: Scorer = null_scorer, text: str = "text") -> DataFrame:
    return document_summary(pages, scan_units(pages, keys, scorer, text), keys)


def sentence_item() -> F.Column:
    """A unit as the results name it."""
    sequence = F.struct(F.col("label"), F.col("prediction"), F.col("confidence"), F.col("probability").alias("probability_leak"), F.col("temperature"), F.col("threshold"))
    return F.struct(
        "page", "sentence", F.col("findings").alias("regex_results"),
        F.struct("status", F.col("tokens").alias("results"), F.col("scored_by").alias("source")).alias("token_analysis"),
        F.struct("status", F.when(F.col("status") == "OK", sequence).alias("result"), F.col("scored_by").alias("source")).alias("sequence_analysis"),
        F.struct(
            "final_label", "risk_level", "confidence_value", "confidence_source", "reasons", "evidence_sources", "analysis_status", decide.types_of(F.col("findings")).alias("regex_types"),
            decide.types_of(F.col("tokens")).alias("token_types"), "sequence_support", "token_support", F.col("errors").alias("model_errors"),
        ).alias("decision"),
        F.col("errors").alias("model_errors"),
    )


def result_documents(pages: DataFrame, document: str, page: str = "page", scorer: Scorer = null_scorer, text: str = "text") -> DataFrame:
    """One row per document: its key as document, schema_version, metadata, pages (each with its sentences) and summary."""
    pages = pages.select(F.col(document).alias("document"), F.col(page).cast("long").alias("page"), F.col(text).alias("text"))
    keys = ["document", "page"]
    units = scan_units(pages, keys, scorer)
    item = units.select(*keys, "unit_no", sentence_item().alias("item"), "final_label", "risk_level", "analysis_status", "errors", "status", "validity", "temperature", "threshold")
    listed = item.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("unit_no", "item"))).alias("u"), F.struct(*decide.counters()).alias("c"), decide.first_metadata().alias("m"))
    full = pages.select(*keys).distinct().join(listed, keys, "left")
    none = F.array().cast(listed.schema["u"].dataType)
    sentences = F.transform(F.coalesce("u", none), lambda x: x["item"]).alias("sentences")
    names = listed.schema["c"].dataType.names
    ordered = F.array_sort(F.collect_list(F.struct("page", sentences)))
    known = F.min_by("m", F.when(F.col("m").isNotNull(), F.col("page")))
    whole = full.groupBy("document").agg(ordered.alias("pages"), known.alias("m"), F.count(F.lit(1)).alias("total_pages"), *(F.coalesce(F.sum(f"c.{n}"), F.lit(0)).alias(n) for n in names))
    summary = F.struct("total_pages", *names)
    status = decide.document_status(F.col("total_sentences"), F.col("complete_analyses"), F.col("failed_analyses"))
    metadata = F.struct(F.lit(PIPELINE).alias("pipeline"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.col("document").cast("string").alias("input_file"), F.array(F.lit(decide.REGEX), F.lit(decide.SEQUENCE)).alias("active_detection_layers"), F.col("m.temperature").alias("sequence_temperature"), F.col("m.threshold").alias("sequence_threshold"), status.alias("analysis_status"), "model_errors_count")
    return whole.select("document", F.lit(SCHEMA_VERSION).alias("schema_version"), metadata.alias("metadata"), "pages", summary.alias("summary"))


def public_summary(results: DataFrame) -> DataFrame:
    """What a caller is told about each document: its status and the counters, without its sentences."""
    counters = [c for c in results.schema["summary"].dataType.names if c not in ("total_pages", "model_errors_count") and not c.endswith("_analyses")]
    return results.select(F.lit("success").alias("status"), "schema_version", "document", F.col("summary.total_pages").alias("pages"), *(F.col(f"summary.{c}").alias(c) for c in counters), F.col("metadata.analysis_status").alias("analysis_status"), F.col("summary.model_errors_count").alias("model_errors_count"))
