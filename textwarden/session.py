"""Session defaults for standalone use; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "textwarden", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    return builder.config(map=defaults | extra).getOrCreate()


def configured(name: str, default: str) -> str:
    """A path that the environment may set as TEXTWARDEN_<NAME>."""
    return os.environ.get(f"TEXTWARDEN_{name.upper()}", default)
