"""Tables that cut the lineage of a job, in the folder that all executors share, and memory that tasks give back."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset a folder of our own is made, which only a local master can share with its tasks;
    on a cluster without the setting this raises.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared one, which ``clear`` deletes."""
    path = f"{shared_folder(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what ``cut`` and ``new_folder`` have made in this session; results that still read it must have been written before."""
    for path in _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.clear()


def trimmed(batches: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of ``mapInArrow`` that gives freed memory back to the system at the end of each partition: Spark uses its
    Python workers again, and what one step has freed would be held through all later ones."""

    @functools.wraps(batches)
    def run(*args: object, **named: object) -> Iterator:
        import pyarrow as pa

        yield from batches(*args, **named)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
