"""Cutting lineage with tables written to the cluster's shared folder.

A written table survives the loss of any executor, is compressed and columnar,
and can be dropped as soon as the next round no longer reads it. The folder is
``spark.checkpoint.dir`` of the session. Only a local session without that
setting (tests) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OPEN: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; an error on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="partwise-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written during one operator call. ``drop`` removes one early; the rest goes when its ``scratch_scope`` or Python ends.

    Tables that a lazily evaluated result still reads must not be dropped.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/partwise-{tag}-{uuid.uuid4().hex}"
        self.made = 0
        _OPEN.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads what was written."""
        self.made += 1
        path = f"{self.base}/{self.made:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_some(self, df: DataFrame) -> DataFrame | None:
        """The same, but None when there were no rows; they are counted as they are written."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out if seen.get["n"] else None

    def last_bytes(self) -> int:
        """Bytes of the table written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{self.made:04d}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def drop(self, df: DataFrame) -> None:
        """Remove the table behind a DataFrame that ``write`` returned."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.split(":", 1)[-1].lstrip("/").startswith(self.base.split(":", 1)[-1].lstrip("/")):
                self._delete(name)

    def drop_all(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes at its end all tables written within it: for long-lived drivers, around a call and the use of its result."""
    before = len(_OPEN)
    try:
        yield
    finally:
        _forget(before)


@atexit.register
def _forget(start: int = 0) -> None:
    for s in _OPEN[start:]:
        try:
            if s.spark.sparkContext._jsc is not None:
                s.drop_all()
        except Exception:  # the session is gone; the folder's owner clears it
            pass
    del _OPEN[start:]
