"""Command line: scan a PDF or a text file, write its results as JSON and CSV, and print a summary.

python -m textwarden INPUT [--json results.json] [--csv results.csv] [--scorer none|rule]

Pages of a text file are parted by form feeds.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.plans import scan
from textwarden.session import session
from textwarden.sources import readers, writers

#: What is printed, in order: a text and the counter's name.
LINES = [("Pages", "total_pages"), ("Sentences", "total_sentences"), ("Leaks", "total_leaks"), ("Non-leaks", "total_non_leaks"), ("Undetermined", "total_undetermined")]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(document, page, text) of a .pdf or .txt file."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no such file: {path}")
    if path.lower().endswith(".pdf"):
        return readers.read_pdf(spark, path).withColumnRenamed("path", "document")
    if not path.lower().endswith(".txt"):
        raise ValueError("a .pdf or .txt file is expected")
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.lit(path).alias("document"), F.posexplode(F.split("value", "\f", -1)).alias("p", "text")).select("document", (F.col("p") + 1).alias("page"), "text")


def main(arguments: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="textwarden", description="Scan a document for sensitive text.")
    parser.add_argument("input", help="a .pdf or .txt file")
    parser.add_argument("--json", default="output/results.json")
    parser.add_argument("--csv", default="output/results.csv")
    parser.add_argument("--scorer", choices=("none", "rule"), default="none")
    given = parser.parse_args(arguments)
    spark = session("textwarden", os.environ.get("SPARK_MASTER", "local[*]"))
    results = scan.result_documents(read_pages(spark, given.input), "document", scorer=scan.rule_scorer if given.scorer == "rule" else scan.null_scorer)
    document = writers.save_document(results, given.json, given.csv)
    for text, name in LINES:
        print(f"{text}: {document['summary'][name]}")
    print(f"Status: {document['metadata']['analysis_status']}")
    print(f"JSON: {given.json}\nCSV: {given.csv}")
    return document["summary"]


if __name__ == "__main__":
    main()
