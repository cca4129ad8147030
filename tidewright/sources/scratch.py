"""Tables that cut the lineage of iterations, in the folder that executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewright.streaming.streams import shared_path


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names; where that is unset and the master is
    local, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_path(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, written; it stays until forgotten()."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(t._path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
