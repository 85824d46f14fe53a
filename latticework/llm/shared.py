"""What the operators of this subpackage share: tables, folders and batches."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources.folders import checkpoint_folder, workers_find_us

#: Rows and bytes of one Arrow batch; a batch of long documents must fit in a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers of a few hundred MB, and let the workers find this package."""
    workers_find_us(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where none is set, as in tests."""
    return checkpoint_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written to the shared folder: the lineage ends there, and lost executors cost nothing.

    Not checkpoint(): its plans carry estimates of sizes, which joins multiply round after round until the driver's heap is full
    of their digits; a written table has the size of its files.
    """
    folder = new_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for df in tables:
        folder = getattr(df, "_cut_folder", None)
        if folder:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go: Spark removes them once the driver's garbage is collected, which may else be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with marks put before them until none is a column of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def fold(key: str, parts: int) -> Column:
    """crc32 of an id, as text, modulo `parts`: the split of documents into folds; a null id is in none of them (-1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(-1))


def bounded(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """About `most` of `rows` rows, the same ones each time, by a hash of the key; all, if there are fewer."""
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) < int(most / rows * (1 << 40)))
