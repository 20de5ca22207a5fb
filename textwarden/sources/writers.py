"""Sinks: results as JSON documents and CSV, reports with stable headers, and clean datasets with a manifest."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.plans.scan import SCHEMA_VERSION

# The columns of a result row.
RESULT_COLUMNS = ["schema_version", "page", "sentence", "analysis_status", "final_label", "risk_level", "confidence_value", "confidence_source", "reasons", "evidence_sources", "regex_types", "regex_values", "token_status", "token_types", "token_values", "token_scores", "sequence_status", "sequence_label", "sequence_prediction", "sequence_confidence", "sequence_probability_leak", "sequence_temperature", "sequence_threshold", "sequence_source", "sequence_validity", "model_errors"]


def flat_rows(units: DataFrame) -> DataFrame:
    """Units of a scan, with a page, as rows of RESULT_COLUMNS; lists become JSON text."""
    listed = lambda c, f: F.to_json(F.transform(c, lambda x: x[f]))
    ok = F.col("status") == "OK"
    made: dict[str, Column] = {
        "schema_version": F.lit(SCHEMA_VERSION), "reasons": F.to_json("reasons"), "evidence_sources": F.to_json("evidence_sources"), "regex_types": listed("findings", "type"),
        "regex_values": listed("findings", "value"), "token_status": F.col("status"), "token_types": listed("tokens", "type"), "token_values": listed("tokens", "value"), "token_scores": listed("tokens", "score"),
        "sequence_status": F.col("status"), "sequence_label": F.when(ok, F.col("label")), "sequence_prediction": F.when(ok, F.col("prediction")), "sequence_confidence": F.when(ok, F.col("confidence")),
        "sequence_probability_leak": F.when(ok, F.col("probability")), "sequence_temperature": F.when(ok, F.col("temperature")), "sequence_threshold": F.when(ok, F.col("threshold")),
        "sequence_source": F.col("scored_by"), "sequence_validity": F.col("validity"), "model_errors": F.to_json("errors"),
    }
    return units.select(*(made.get(c, F.col(c)).alias(c) for c in RESULT_COLUMNS))


def rows_of(results: DataFrame) -> DataFrame:
    """The rows of RESULT_COLUMNS of result documents."""
    items = results.select(F.explode("pages").alias("p")).select(F.explode("p.sentences").alias("s")).select("s.*")
    units = items.select(
        "page", "sentence", F.col("regex_results").alias("findings"), F.col("token_analysis.status").alias("status"), F.col("token_analysis.results").alias("tokens"), "sequence_analysis.result.*",
        F.col("sequence_analysis.source").alias("scored_by"), F.col("decision.sequence_support.validity").alias("validity"), "decision.final_label", "decision.risk_level", "decision.confidence_value",
        "decision.confidence_source", "decision.reasons", "decision.evidence_sources", "decision.analysis_status", F.col("model_errors").alias("errors"),
    )
    return flat_rows(units.withColumnRenamed("probability_leak", "probability"))


def write_results(results: DataFrame, folder: str) -> None:
    """Result documents as JSON, one a line, and their rows as CSV with a header, a file per partition."""
    results.drop("document").write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/results_json")
    rows_of(results).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{folder}/results_csv")


def save_document(results: DataFrame, json_path: str, csv_path: str) -> dict:
    """The single document of results as an indented JSON file and a CSV file that begins with a byte-order mark, both
    written by the driver; returns the document."""
    found = results.drop("document").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).take(2)
    if len(found) != 1:
        raise ValueError("one document is expected")
    document = json.loads(found[0].j)
    for path in (json_path, csv_path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(json_path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)
    with open(csv_path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(RESULT_COLUMNS)
        out.writerows(tuple(r) for r in rows_of(results).toLocalIterator())
    return document


def write_report(df: DataFrame, folder: str, name: str) -> None:
    """A small report as one CSV with its header even when it is empty."""
    text = F.concat_ws(",", *(F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', '""'), F.lit('"')) for c in df.columns))
    head = df.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(",".join(f'"{c}"' for c in df.columns)).alias("value"))
    lines = head.unionByName(df.select(F.lit(1).alias("o"), text.alias("value")))
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(f"{folder}/{name}")


def write_reports(reports: dict[str, DataFrame], folder: str, title: str) -> None:
    """Several reports: each as CSV under its name, their rows as JSON lines, and a text with the number of rows of each."""
    lines = [title]
    for name, df in reports.items():
        write_report(df, folder, f"{name}.csv")
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}.json")
        lines.append(f"{name}: {df.sparkSession.read.json(f'{folder}/{name}.json', schema=df.schema).count()} rows")
    spark = next(iter(reports.values())).sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{folder}/summary.txt")


def json_safe(rows: DataFrame) -> DataFrame:
    """Rows as JSON text with every field, null ones too."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_dataset(parts: dict[str, DataFrame], folder: str, labels: DataFrame | None = None) -> DataFrame:
    """Each split as JSON lines, the label schema beside them; returns and writes the manifest (split, records)."""
    counts = None
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        row = df.sparkSession.read.text(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("split"), "records")
        counts = row if counts is None else counts.unionByName(row)
    counts.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    if labels is not None:
        labels.coalesce(1).agg(F.transform(F.array_sort(F.collect_list(F.struct("label_id", "label"))), lambda x: x["label"]).alias("labels")).write.mode("overwrite").json(f"{folder}/label_schema")
    return counts
