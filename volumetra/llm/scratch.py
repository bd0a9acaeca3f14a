"""Tables that cut lineage: written once to the folder all executors share, then read back.

The folder is ``spark.checkpoint.dir`` of the session. Where that is unset (plain local tests) a folder
of its own below the warehouse is taken; on a cluster that is an error, so no machine-local path is ever used there.
Whoever calls operators may name a list in which the paths of their tables are noted (``scope``), to delete just these.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The innermost list takes the paths; the outermost is that of callers without a scope.
_SCOPES: list[list] = [[]]


@contextmanager
def scope(paths: list) -> Iterator[list]:
    """Tables written and values shared inside are noted in ``paths``."""
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()


def root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/") + "/volumetra"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """A broadcast value that ``clear`` takes back from driver and executors."""
    shared = spark.sparkContext.broadcast(value)
    _SCOPES[-1].append(shared)
    return shared


def clear(spark: SparkSession, paths: list | None = None) -> int:
    """Delete the tables and take back the values noted in ``paths`` (by default those made outside of any scope); call it once
    what reads them has been stored. The number of tables is returned."""
    jvm, conf, n = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), 0
    paths = _SCOPES[0] if paths is None else paths
    while paths:
        item = paths.pop()
        if not isinstance(item, str):
            item.destroy()
            continue
        path = jvm.org.apache.hadoop.fs.Path(item)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def give_back() -> None:
    """Hands a worker's freed memory back to the system, at the end of a task: workers live on, and their peaks would add up."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # of glibc alone
        trim(0)


def let(value, body):
    """``body(value)`` with ``value`` computed once, for use below a lambda that would compute it per element."""
    from pyspark.sql import functions as F

    return F.element_at(F.transform(F.array(value), body), 1)
