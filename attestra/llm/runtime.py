"""Small shared helpers of the subpackage: checkpoint folder, table readers, block iteration."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters handled at once by the vectorised text code; bounds a worker's memory whatever the batch holds.
BLOCK_CHARS = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made and run within drop their shuffle files when they have run, else these stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpoint(df: DataFrame, drop: bool = False) -> DataFrame:
    """Cut lineage in the shared folder named by ``spark.checkpoint.dir``; only a local master gets a local one where it is unset.

    With ``drop`` the shuffle files that led to it go at once.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="attestra-checkpoint-"))
    with shuffles_dropped(df.sparkSession) if drop else nullcontext():
        return (df.select("*") if drop else df).checkpoint(eager=True)


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` characters each; a longer text is a block of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty strings."""
    return ["" if x is None else x for x in column.to_pylist()]


def words(text: F.Column | str) -> F.Column:
    """Array of words: maximal runs of letters and digits of the lower-cased text; null stays null."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
