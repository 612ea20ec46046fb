"""Shared folder for written intermediates.

Intermediates go below `spark.checkpoint.dir`, so every executor sees them and a
lost executor loses nothing. Only where a local session lacks the setting, as in tests, a
folder of this machine is set for it. `scope` removes what was stored inside it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="linktm-")
    return _local_folders[app]


def full_uri(spark: SparkSession, path: str) -> str:
    """The path as Spark understands it, with its file system: readers that do not go
    through Spark must look in the same place."""
    inner = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return inner.getFileSystem(conf).makeQualified(inner).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has written to yet."""
    path = f"{shared_folder(spark)}/linktm/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of paths of intermediates that this thread stores inside."""
    paths: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), paths]
    try:
        yield paths
    finally:
        _scopes.open = _scopes.open[:-1]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediates that this thread stores inside are removed at its end: frames that read them
    must have been used by then."""
    with recorded() as paths:
        try:
            yield
        finally:
            for path in paths:
                remove(spark, path)


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` as Parquet in the shared folder and read it back: the plan is
    cut, and later readers prune columns and push filters."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def materialize_counted(frame: DataFrame, name: str, wanted: Column | None = None) -> tuple[DataFrame, int]:
    """`materialize`, and the number of rows (for which `wanted` holds), counted as they are written and by no job more."""
    seen = Observation()
    count = F.count(F.lit(1)) if wanted is None else F.count_if(wanted)
    stored = materialize(frame.observe(seen, count.alias("rows")), name)
    return stored, seen.get["rows"]
