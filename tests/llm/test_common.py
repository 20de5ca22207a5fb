"""Shared folders, skewed joins and memory that is given back."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textwarden.llm import common


def test_shared_folder_and_clean_up(spark):
    one = common.written(spark.range(3), "a-test")
    folder = common._MADE[spark.sparkContext.applicationId][-1]
    assert folder.startswith("file:///") and one.count() == 3
    path = folder.removeprefix("file://")
    assert os.path.isdir(path) and common.clean_up(spark) >= 1 and not os.path.exists(path)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    """Only local mode may set a folder of its own."""
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(), "x")


def test_store_names(monkeypatch):
    """What Spark calls s3a is s3 to the library that opens files."""
    asked = []

    class Fake:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    monkeypatch.setattr(common.pafs, "FileSystem", Fake)
    for uri in ("s3a://b/k", "s3n://b/k", "s3://b/k", "file:///x", "hdfs://h/x"):
        common.open_fs(uri)
    assert asked == ["s3://b/k", "s3://b/k", "s3://b/k", "file:///x", "hdfs://h/x"]


def test_attach_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_PARTS", 4)
    rows = spark.createDataFrame([(k % 3 if k < 90 else 100 + k, k) for k in range(100)], "g long, v long")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = common.attach(rows, groups, ["g"], "n", 100).collect()
    assert sorted((r.v, r.n) for r in got) == [(k, 30 if k < 90 else 1) for k in range(100)]


def test_released_passes_rows_on():
    batches = [pa.RecordBatch.from_pydict({"x": [1, 2]}), pa.RecordBatch.from_pydict({"x": [3]})]

    @common.released
    def run(given):
        yield from given

    assert [b.num_rows for b in run(iter(batches))] == [2, 1]


def test_memory_of_the_jvm_is_given_back(spark, monkeypatch):
    """The collection between steps also trims the JVM; where it can't be, nothing is raised."""
    said = common.trim_jvm(spark)
    assert said is None or "rim native heap" in said
    calls = []
    monkeypatch.setattr(common, "trim_jvm", calls.append)
    monkeypatch.setattr(common, "_collected", float("-inf"))
    common._forget(spark)
    common._forget(spark)
    assert calls == [spark]
