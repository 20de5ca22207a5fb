"""The row-wise part of the scan on streams: findings of new texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textwarden.functions.patterns import findings
from textwarden.functions.text import normalize_document


def findings_stream(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per finding of the normalised text; narrow, so it needs neither state nor watermark."""
    clean = texts.select(key, findings(normalize_document(F.col(text))).alias("found"))
    return clean.select(key, F.explode("found").alias("f")).select(key, "f.*")


def counts_stream(texts: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of each type per window of event time; what comes later than delay isn't counted, so old windows can go."""
    timed = texts.withWatermark(time, delay).select(F.col(time).alias("_time"), F.explode(findings(normalize_document(F.col(text)))).alias("f"))
    counted = timed.groupBy(F.window("_time", window).alias("w"), F.col("f.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "type", "n")


def start(texts: DataFrame, sink: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Appends findings to Parquet files, exactly once by the checkpoint."""
    return findings_stream(texts, key, text).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
