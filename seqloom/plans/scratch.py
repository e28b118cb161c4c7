"""Intermediate tables in the folder all executors share.

A step whose result is read more than once, or a loop whose plan would grow, is written as a Parquet table below
``spark.checkpoint.dir``. That cuts the lineage, survives the loss of executors, is compressed and columnar, and is read
back with column pruning.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_BASES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    Where neither is set, a session of one machine (``local``) gets a folder of its own; on a cluster that is an error, since executors would each write to their own disk.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    app = context.applicationId
    if app not in _OWN:
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        _OWN[app] = f"file://{folder}"
        atexit.register(_remove, folder)
        context.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


class Scratch:
    """A group of intermediate tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        _BASES.setdefault(spark.sparkContext.applicationId, []).append(self.base)

    def path(self, name: str = "t") -> str:
        self._count += 1
        return f"{self.base}/{name}-{self._count}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and read it back."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> int:
    """Remove all intermediate tables of this session; call it when no result that reads them is needed any more. Returns how many groups there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    bases = _BASES.pop(spark.sparkContext.applicationId, [])
    for base in bases:
        folder = jvm.org.apache.hadoop.fs.Path(base)
        folder.getFileSystem(conf).delete(folder, True)
    return len(bases)
