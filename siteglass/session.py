"""A session with the settings the library relies on."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, skewed joins split; anything given in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName("siteglass")
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


@functools.cache
def _of_this_process() -> str:
    base = tempfile.mkdtemp(prefix="siteglass-sinks-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share, below ``spark.checkpoint.dir``; without it only a local master has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or _of_this_process()).rstrip('/')}/sinks-{uuid.uuid4().hex}"
