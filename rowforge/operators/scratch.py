"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where that is unset, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rowforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    def last() -> None:
        try:
            forget(spark, path)
        except Exception:  # the session is gone already; the folder is scratch
            pass

    atexit.register(last)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowforge/{label}-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
