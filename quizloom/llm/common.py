"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(k))


def held_out(id_col: str, k: int, value: int) -> Column:
    """Whether a row's remainder is `value`; false for a NULL id, which is never a training row either."""
    return F.coalesce(remainder(id_col, k) == value, F.lit(False))


def use_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() write to spark.checkpoint.dir. Only where that is unset: in local mode, as in tests, to a temporary
    folder, and on a cluster to a folder within the warehouse, which executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            shared = tempfile.mkdtemp(prefix="checkpoints-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    use_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that later steps neither compute it again nor lose it with an executor."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a folder of its own within the shared checkpoint folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is run hands so many rows at a time to Python workers, and so many texts or sets at most are in their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hand_few(spark: SparkSession, rows: int) -> None:
    """From now on no more rows at a time are handed to Python workers in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))
