"""Written intermediate results, in the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """``df``, written once to ``spark.checkpoint.dir`` and read from there; only a session in one process may go without that setting."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stages-"))
    return df.checkpoint(eager=True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table is there as a whole, on whatever file system its path names."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
