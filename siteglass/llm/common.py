"""What the training-data operators share: table access, work folders and Arrow mapping."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as Spark's own reader sees it.

    A table of texts in fewer splits than there are cores (a small single file) is dealt out, so all cores work.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


_MADE: list[str] = []


@functools.cache
def _local_base() -> str:
    """A temporary folder of this process, gone with it."""
    base = tempfile.mkdtemp(prefix="siteglass-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can read.

    Only a local master without that setting falls back to a temporary folder; on a cluster a missing setting is an
    error, since a machine-local folder would lose rows. Results read from these folders, so they stay until
    :func:`drop_work` is called.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    _MADE.append(f"{base.rstrip('/')}/siteglass-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_work(spark: SparkSession, since: int = 0) -> int:
    """Delete the work folders made so far (or after the first ``since``), once no result reads from them any more;
    returns their number."""
    n = len(_MADE) - since
    while len(_MADE) > since:
        drop(spark, _MADE.pop())
    return n


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def work_made() -> int:
    """How many work folders there are by now, to drop those made later."""
    return len(_MADE)


def materialize(df: DataFrame, folder: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to a dict of columns, typed by ``schema``."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn(batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, target)


BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as a row may be a long text; a smaller setting of the session stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)


def docs_of(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text with null as the empty text, next to the named columns only."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
