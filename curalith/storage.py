"""Cutting lineage: intermediate tables go to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as
    in tests. Elsewhere executors would not see each other's files, so that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="curalith-")
        atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return path


#: What this session has written to the shared folder and not removed, and the tables that are there.
_written: list[str] = []
_tables: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``remove_written`` removes it."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def mark() -> int:
    """A place to which ``remove_written`` can go back."""
    return len(_written)


def remove_written(spark: SparkSession, since: int = 0) -> int:
    """Removes the intermediate tables written since a ``mark``, by default all, and returns how many. To be called when a job's results are
    saved: frames that still read these tables fail afterwards, so nothing is removed before."""
    jvm, gone = spark.sparkContext._jvm, 0
    while len(_written) > since:
        if table := _tables.pop(_written[-1], None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
    """As ``materialise``, in ``n`` buckets by ``keys``: joins by these keys do not shuffle the table any more."""
    path = fresh_path(df.sparkSession, name)
    _tables[path] = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(_tables[path])
    return df.sparkSession.table(_tables[path])
