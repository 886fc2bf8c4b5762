"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage for good: a lost executor costs a re-read, not
a recomputation, and nothing depends on a local block.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


TASK_ROWS = 1 << 19
SCAN_ROWS = 1 << 16  # of a given table that a task derives rows from
_paths: dict[int, tuple[weakref.ref, str]] = {}  # where materialize wrote a DataFrame
_own: dict[str, str] = {}  # by application, where spark.checkpoint.dir is unset


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local tests, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="provenir-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _paths[id(written)] = weakref.ref(written), path
    return written


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote, of a round that nothing reads any more; other tables stay as they are."""
    written, path = _paths.pop(id(df), (None, ""))
    if written is None or written() is not df:
        return
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df hashed by keys into as many partitions as its rows need, so that a task's share of a join or grouping by them doesn't grow with the table; unchanged where the session's own number is enough."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key that tells its rows apart into tasks of SCAN_ROWS: a file's bytes, and its row groups even more, may leave all that is derived from its rows to one task."""
    n = -(-df.count() // SCAN_ROWS)
    return df.repartition(n, key) if n > 1 else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
