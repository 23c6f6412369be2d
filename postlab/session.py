"""Session set-up and the two ways this package cuts lineage: checkpoints and stored tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postlab", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; everything else is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a machine-local
    folder would be lost with its machine.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
        return
    if context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="postlab-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that ``stored_alone`` removes; None outside of it.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, removed when the program ends."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if _PASSING.get() is not None:
        _PASSING.get().append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses, unless the session is gone."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


#: Spark's setting for removing the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = Lock()
_WRITERS: Counter[str] = Counter()
_BEFORE: dict[str, str | None] = {}


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What ends in here leaves no shuffle files: a written table needs none of them again.

    Several threads may write at the same time; the setting goes back when the last one is done.
    """
    context = spark.sparkContext.applicationId
    with _LOCK:
        if not _WRITERS[context]:
            _BEFORE[context] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITERS[context] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS[context] -= 1
            if not _WRITERS[context]:
                before = _BEFORE.pop(context)
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a checkpoint, the copy keeps columns apart, so a later reader reads only what it needs.
    """
    path = shared_folder(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, n: int, column: str, name: str = "table") -> DataFrame:
    """``stored`` in ``n`` buckets by ``column``: who groups by that column later reads the rows where they lie and moves none.

    The buckets are known by a table of the session's catalogue, whose files lie in the shared folder and go as those of
    ``stored`` do.
    """
    spark, path, table = df.sparkSession, shared_folder(df.sparkSession, name), f"postlab_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (compression 'zstd') "
              f"CLUSTERED BY (`{column}`) INTO {n} BUCKETS LOCATION '{path}'")
    atexit.register(_forget, spark, table)
    with _shuffles_removed(spark):
        df.repartition(n, column).write.insertInto(table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    """Take a table out of the catalogue, unless the session is gone."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def stored_alone(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """``stored_in_turn`` for one ``make``."""
    return stored_in_turn([make], name)


def stored_in_turn(makes: list[Callable[[], DataFrame]], name: str = "table") -> DataFrame:
    """The rows of each ``make()``, stored one after the other as one table, without what a ``make`` stores on its way: that is removed
    when its rows are written, before the next begins.

    Only for a ``make`` whose own tables nobody else goes on using.
    """
    path = None
    for make in makes:
        passing: list[str] = []
        outer = _PASSING.set(passing)
        try:
            frame = make()
        finally:
            _PASSING.reset(outer)
        spark = frame.sparkSession
        path = path or shared_folder(spark, name)
        with _shuffles_removed(spark):
            frame.write.mode("append").parquet(path, compression="zstd")
        for passed in passing:
            _remove(spark, passed)
    return spark.read.schema(frame.schema).parquet(path)
