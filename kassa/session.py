"""Session helpers: a local session for tests and bench; the shared folder and
the scratch tables in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "kassa", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark: no web page, UTC, few
    shuffle partitions; everything else is Spark's default."""
    spark = (SparkSession.builder
             .master(f"local[{cores}]")
             .appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it and every executor reads it; without it
    this is an error there, since a folder of the driver's machine holds only
    part of what executors write. A purely local session gets a folder of its
    own, which ``DataFrame.checkpoint()`` then uses too.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kassa-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder. It is deleted by
    ``release_scratch``, at the latest when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    store, target = _store(spark, path)
    return store.exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder of ours through the store's own file system."""
    store, target = _store(spark, path)
    return store.delete(target, True)


def release_scratch(spark: SparkSession | None = None, paths: list[str] | None = None) -> None:
    """Delete scratch tables (all of ``spark``'s, or the given ones) once no
    DataFrame reads them any more."""
    for entry in list(_SCRATCH):
        own, path = entry
        if (spark is None or own is spark) and (paths is None or path in paths):
            _SCRATCH.remove(entry)
            if own.sparkContext._jsc is not None:
                delete_path(own, path)


_HOLDING: ContextVar[list[DataFrame] | None] = ContextVar("holding", default=None)


def held(df: DataFrame) -> DataFrame:
    """``df`` kept by Spark (memory, else the executors' disks) from its first
    use on, so that several branches of one query compute it once; nothing runs
    here, and lost parts are computed again. The plan gets a mark of its own
    that the optimizer removes: no other query is answered from the held rows.
    Inside ``holding()`` the caller releases it."""
    mark = F.lit(uuid.uuid4().hex)
    df = df.where(mark == mark).persist(StorageLevel.MEMORY_AND_DISK)
    frames = _HOLDING.get()
    if frames is not None:
        frames.append(df)
    return df


@contextmanager
def holding() -> Iterator[list[DataFrame]]:
    """The frames held meanwhile."""
    frames: list[DataFrame] = []
    token = _HOLDING.set(frames)
    try:
        yield frames
    finally:
        _HOLDING.reset(token)


def _unpersist(frames: list[DataFrame]) -> None:
    for df in frames:
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()


def release_with(result: DataFrame, frames: list[DataFrame]) -> DataFrame:
    """``result``, whose held frames go when it is garbage."""
    if frames:
        weakref.finalize(result, _unpersist, frames).atexit = False
    return result


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage: Spark deletes the shuffle files of
    plans that are gone only then, by itself at most every half hour."""
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _release_all() -> None:
    try:
        release_scratch()
    except Exception:  # the JVM is gone before us: nothing can be deleted any more
        _SCRATCH.clear()
