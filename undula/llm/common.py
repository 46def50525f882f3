"""What the training-data operators share: input tables, shared storage, sampling and grouped iteration."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: ASCII letters, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a temporary one in local
    mode, as in tests; on a cluster, where executors can't see such a folder, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="undula-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def dropped_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder of this run's own removed when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back.

    Later stages read the files, so a lost executor costs its running tasks and nothing upstream. They go when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    dropped_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the key's value and the seed; null keys share one number."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key written as text, modulo `folds`; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tidy(run):
    """A function from batches to batches that gives the memory it no longer needs back when its task ends: Python workers go
    on to other tasks, and what each stage leaves behind would add up."""

    def each(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return each


def complete_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Batches sorted by the keys, cut so that no run of equal keys is split, with the runs' starts and ends."""
    rest: pd.DataFrame | None = None

    def runs(batch: pd.DataFrame) -> np.ndarray:
        values = batch[keys].to_numpy()
        return np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])

    for batch in batches:
        if batch.empty:
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        starts = runs(batch)
        rest = batch.iloc[starts[-1] :].reset_index(drop=True)
        if len(starts) > 1:
            yield batch.iloc[: starts[-1]].reset_index(drop=True), starts[:-1], starts[1:]
    if rest is not None:
        yield rest, np.array([0]), np.array([len(rest)])


def broadcast_if_small(table: DataFrame, rows: int = 1_000_000, megabytes: int | None = None) -> DataFrame:
    """A table of a few numbers a row, marked for broadcasting if it has no more than so many rows; else as it is. For a written
    table of longer rows `megabytes` bounds the size of its files, too."""
    if megabytes is not None and int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > megabytes << 20:
        return table
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
