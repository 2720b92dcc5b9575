"""Cutting lineage: tables in the folder that the driver and all executors share; and into how many parts rows are dealt."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Short rows that one task sorts or joins, whatever the input.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode only, a new folder where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A folder of this application in the shared one, which goes when the interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex[:12]}"

        def forget(path=_ROOTS[app]):
            with contextlib.suppress(Exception):  # the session may be gone already
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

        atexit.register(forget)
    return _ROOTS[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once and read again; what it was made of is forgotten, its constraints too, which grow with every round of a loop."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, most: int = TASK_ROWS) -> int:
    """How many parts hold at most about `most` of so many rows each; for few rows as many as a shuffle has, but not parts of a few rows."""
    return max(1, -(-rows // most), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 10_000))
