"""Dataset readers. Bad rows are kept apart with their file and a preview, or fail the read in the strict mode."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.functions.text import binary_label

PREVIEW = 160
BOM = "﻿"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line numbers from 1, however many tasks read a file.

    A line's number is its place within its block of the file behind the lines of the blocks before; only the blocks'
    sizes are gathered, a row for each.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    blocks = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(F.broadcast(blocks.withColumn("_before", before).drop("_n")), ["file", "_at"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return placed.select("file", number.alias("line_no"), F.when(number == 1, F.regexp_replace("line", f"^{BOM}", "")).otherwise(F.col("line")).alias("line"))


MALFORMED = "file string, line_no long, error string, preview string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, malformed): one JSON object a line, blank lines skipped, a byte-order mark at the beginning ignored.

    With strict, a bad line raises when the records are computed. Records carry file and line_no.
    """
    parsed = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("r", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.col("line").rlike(r"^\s*\{")
    if strict:
        told = F.concat(F.lit("bad JSON in "), "file", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.substring("line", 1, PREVIEW))
        parsed = parsed.withColumn("r", F.when(broken, F.raise_error(told)).otherwise(F.col("r")))
        return parsed.select("file", "line_no", "r.*").drop("_bad"), spark.createDataFrame([], MALFORMED)
    good = parsed.where(~broken).select("file", "line_no", "r.*").drop("_bad")
    return good, parsed.where(broken).select("file", "line_no", F.lit("MalformedJSON").alias("error"), F.substring("line", 1, PREVIEW).alias("preview"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_csv(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, malformed): a header names the columns; rows of another width are malformed, or, if not strict, read as
    far as they go. Records carry file and line_no; the header is line 1, so rows begin at 2."""
    names = [c.lstrip(BOM) for c in spark.read.option("header", True).csv(path).columns]
    schema = ", ".join(f"{_quoted(c)} string" for c in names)
    rows = numbered_lines(spark, path).where("line_no > 1 AND line <> ''").withColumn("r", F.from_csv("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    if not strict:
        return rows.select("file", "line_no", "r.*").drop("_bad"), spark.createDataFrame([], MALFORMED)
    broken = F.col("r._bad").isNotNull()
    good = rows.where(~broken).select("file", "line_no", "r.*").drop("_bad")
    return good, rows.where(broken).select("file", "line_no", F.lit("MalformedCSVRow").alias("error"), F.substring("line", 1, PREVIEW).alias("preview"))


def read_any(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """By suffix."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path)
    if path.lower().endswith((".jsonl", ".json")):
        return read_jsonl(spark, path, schema)
    raise ValueError(f"unknown format: {path}")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A lenient CSV reader: (file, line_no, text, the other columns); the text is the first of the columns text,
    sentence and segment that isn't empty."""
    rows, _ = read_csv(spark, path, strict=False)
    names = [c for c in ("text", "sentence", "segment") if c in rows.columns]
    if not names:
        raise ValueError("a column text, sentence or segment is expected")
    return rows.withColumn("text", first_text(*map(F.col, names)))


def _asserted(ok: Column, value: Column, message: str) -> Column:
    where = F.concat(F.lit(f"{message} in "), F.col("file"), F.lit(", line "), F.col("line_no").cast("string"))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(where).cast("string"))


SEQUENCE_SCHEMA = "text string, label string, sequence_label string, document_label string, case_id string, id string, pair_id string, category string, difficulty string, group_id string, expected_reason string"
TOKEN_SCHEMA = "text string, tokens array<string>, ner_tags array<int>, tag_names array<string>, case_id string, id string, category string, group_id string, document_label string"


def sequence_rows(records: DataFrame) -> DataFrame:
    """Records of read_jsonl(SEQUENCE_SCHEMA) or read_csv() as evaluation rows: row_id, text, label 0 or 1, label_name and
    the descriptions with their defaults. A missing text or an unknown label raises."""
    have = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    label = binary_label("evaluate", F.coalesce(*map(have, ("label", "sequence_label", "document_label"))))
    number = records.select("*", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("_k"))
    text = _asserted(F.trim(have("text")) != "", have("text"), "missing text")
    name = _asserted(label.isNotNull(), label, "unknown label")
    filled = {c: F.coalesce(have(c), F.lit(d)).alias(c) for c, d in (("pair_id", ""), ("category", "UNKNOWN"), ("difficulty", "unknown"), ("group_id", ""), ("expected_reason", ""))}
    row_id = F.coalesce(have("case_id"), have("id"), F.col("_k").cast("string"))
    return number.select("file", "line_no", row_id.alias("row_id"), text.alias("text"), (name == "LEAK").cast("int").alias("label"), name.alias("label_name"), *filled.values())


def token_rows(records: DataFrame) -> DataFrame:
    """Records of read_jsonl(TOKEN_SCHEMA) as evaluation rows; tokens and tags of different number raise."""
    number = records.select("*", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("_k"))
    fits = F.col("tokens").isNotNull() & ~F.exists("tokens", lambda t: t.isNull()) & (F.size("tokens") == F.size("ner_tags"))
    checked = _asserted(fits, F.coalesce("text", F.array_join("tokens", " ")), "tokens and tags don't fit")
    label = binary_label("evaluate", F.col("document_label"))
    row_id = F.coalesce("case_id", "id", F.col("_k").cast("string"))
    return number.select("file", "line_no", row_id.alias("row_id"), checked.alias("text"), "tokens", "ner_tags", F.coalesce("tag_names", F.array().cast("array<string>")).alias("tag_names"), F.coalesce("category", F.lit("UNKNOWN")).alias("category"), F.coalesce("group_id", F.lit("")).alias("group_id"), F.when(F.col("document_label").isNotNull(), (label == "LEAK").cast("int")).alias("document_label"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file that holds one object."""
    found = spark.read.option("wholetext", True).text(path).first()
    config = json.loads(found.value.lstrip(BOM)) if found else None
    if not isinstance(config, dict):
        raise ValueError("a JSON object is expected")
    return config


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def named_path(argument: str) -> tuple[str, str]:
    """NAME=PATH, or a path that is named after its file."""
    name, sign, path = argument.partition("=")
    if not sign:
        name, path = argument.replace("\\", "/").rstrip("/").rpartition("/")[2].rpartition(".")[0] or argument, argument
    if not name or not path:
        raise ValueError("NAME=PATH is expected")
    return name, path


def first_text(*columns: Column) -> Column:
    """The first of the columns that isn't empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def discover(spark: SparkSession, folder: str, prefixes: list[str]) -> list[str]:
    """Dataset files (.jsonl, .csv) whose name holds a known prefix, in order. Listed by Spark, so any store works."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jsonl,csv}").option("recursiveFileLookup", True).load(folder).select("path")
    return sorted(r.path for r in files.collect() if any(p in r.path.rpartition("/")[2] for p in prefixes))


def read_label_schema(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, label, prefix, entity_type) from {"labels": [...]}; O alone by default."""
    labels = spark.read.option("multiLine", True).schema("labels array<string>").json(path)
    rows = labels.select(F.posexplode(F.coalesce("labels", F.array(F.lit("O")))).alias("label_id", "label"))
    part = lambda k: F.nullif(F.regexp_extract("label", "^([BI])-(.*)$", k), F.lit(""))
    return rows.select("label_id", "label", part(1).alias("prefix"), part(2).alias("entity_type"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) where a PDF library is installed; pages count from 1 and empty text is ''."""
    import importlib.util

    if importlib.util.find_spec("pypdf") is None:
        raise RuntimeError("reading PDF files needs pypdf; give the engine a table of page texts instead")
    if not path.lower().endswith(".pdf"):
        raise ValueError("a .pdf path is expected")

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = PdfReader(io.BytesIO(content)).pages
                yield pd.DataFrame([(name, i, p.extract_text() or "") for i, p in enumerate(found, 1)], columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page int, text string")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents of schema 2.0 as they were written; what isn't one raises."""
    raw = spark.read.option("multiLine", path.lower().endswith(".json")).json(path)
    if "_corrupt_record" in raw.columns or "schema_version" not in raw.columns or raw.where("schema_version <> '2.0' OR schema_version IS NULL").limit(1).count():
        raise ValueError("results of schema 2.0 are expected")
    if "pages" not in raw.columns or not raw.schema["pages"].dataType.simpleString().startswith("array"):
        raise ValueError("results must contain a list of pages")
    if raw.where("pages IS NULL").limit(1).count():
        raise ValueError("results must contain a list of pages")
    page = raw.schema["pages"].dataType.elementType
    if page.typeName() == "struct" and ("sentences" not in page.names or page["sentences"].dataType.typeName() != "array"):
        raise ValueError("each page must contain a list of sentences")
    return raw


def result_sentences(results: DataFrame) -> DataFrame:
    """The sentences of result documents, with both page numbers: container_page, sentence_page, unit_no, item."""
    pages = results.select(F.explode("pages").alias("p")).select(F.col("p.page").alias("container_page"), F.posexplode("p.sentences").alias("unit_no", "item"))
    return pages.select("container_page", F.col("item.page").alias("sentence_page"), "unit_no", "item")
