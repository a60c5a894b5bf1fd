"""Where frames that later steps read many times are kept, and how narrow inputs are spread over all cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Estimated bytes a core up to which a frame counts as small.
SMALL = 32 << 20
#: Tasks that texts are dealt out to at most.
MOST_PARTS = 4096


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets a folder of its own.

    On a cluster an unset folder is an error: executors would write to their own disks.
    """
    context = spark.sparkContext
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillstream-"))
        found = context.getCheckpointDir()
    return found


def cut(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """Writes the frame to the checkpoint folder and reads it from there.

    With `partitioned`, Catalyst still knows afterwards by what the frame is dealt out. An adaptive plan hides that, so the
    frame is planned without; for frames that have but a plain exchange. With spark.cleaner.referenceTracking.cleanCheckpoints
    Spark deletes the files once nothing refers to the frame.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    if not partitioned:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def estimated(df: DataFrame) -> int:
    """Catalyst's estimate of the frame's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame) -> bool:
    """Whether Catalyst's estimate of the frame is below SMALL bytes a core, so that dealing it out costs next to nothing."""
    return estimated(df) < SMALL * df.sparkSession.sparkContext.defaultParallelism


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deals texts out by the hash of a key, to at least all cores and to one task for each SMALL / 16 estimated bytes.

    However few row groups or files a table has, its texts are cut into words by tasks of one size. The number is given, so
    that no adaptive plan joins tasks by the bytes of their texts, which say little of the work on them.
    """
    size, cores = estimated(df), df.sparkSession.sparkContext.defaultParallelism
    if size > 1 << 50:  # rows that come from no file have no estimate
        return df.repartition(key)
    return df.repartition(max(cores, min(-(-size // (SMALL // 16)), MOST_PARTS)), key)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a small frame out to all cores by the hash of keys; a larger one stays as its files are split.

    A small file of one row group would otherwise be one task, however many cores there are.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if is_small(df) else df
