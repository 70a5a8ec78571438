"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given).

    Where neither is set, an application whose executors are threads of the driver
    (master ``local``) gets a temporary folder, deleted at exit; any other is refused,
    as its executors wouldn't see a folder of the driver's machine.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        folder = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_dirs[context.applicationId]


#: Most rows of a round that go through the driver.
SMALL = 20_000


class Scratch:
    """Writes tables once and reads them again, so that lineage ends there and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # holding a table keeps its id from being used again
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def keep_round(self, df: DataFrame, last: int | None) -> tuple[DataFrame, int | None]:
        """Keep one round of an iteration: (table, rows), rows being None for a large one.

        A round after a small one is fetched with a limit of ``SMALL`` rows; if it
        fits, it becomes literal rows of the plan, which spares a write and a read.
        Larger rounds are written, whatever their size.
        """
        if last is not None and last <= SMALL // 4:
            got = df.limit(SMALL + 1).toArrow()
            if got.num_rows <= SMALL:
                return self.spark.createDataFrame(got, df.schema), got.num_rows
        out = self.keep(df)
        return out, 0 if out.isEmpty() else None

    def clear(self) -> None:
        """Delete all tables that were kept."""
        self._delete(self.root)
        self.paths.clear()

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for df in kept:
            if (kept_at := self.paths.pop(id(df), None)) is not None:  # rounds that became literal rows have none
                self._delete(kept_at[1])

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
