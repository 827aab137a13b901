"""Session construction and the shared checkpoint folder.

On a cluster the session is built by the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it.  ``local_session`` is for tests and the
bench and sets a checkpoint folder only when none is configured.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_registered: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "kpiforge") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only when unset.

    A cluster names the folder in ``spark.checkpoint.dir``; that setting wins.
    The fallback (tests, local bench) is a fresh folder under the system temp
    directory, never reused between runs; off a local master executors could not
    see it, so there the setting is required.
    """
    path = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kpiforge-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, path)
    if path not in _registered:
        spark.sparkContext.setCheckpointDir(path)
        _registered.add(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")


#: Shuffle files of a written table are of no further use: Spark may remove them when the write ends.
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("kpiforge_scratch", default=())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where a plan would otherwise recompute an expensive shuffle (a
    window over the whole log) for every later reference.  Unlike
    ``persist`` the copy survives lost executors; unlike ``checkpoint()`` it
    is columnar, so later reads prune columns and push filters.  The shuffle
    files behind it are removed; the table goes when its ``scratch`` scope ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP_KEY, "false")
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP_KEY, before)
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return spark.read.parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of every query of this session go when the query ends."""
    spark.conf.set(_CLEANUP_KEY, "true")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope that owns the tables which ``materialize`` writes in it, and deletes them at its end.

    Yields ``keep``, which writes a table into the enclosing scope: what leaves the scope must be
    written by it, since a DataFrame that reads a deleted table cannot run any more.
    """
    outer, own = _scopes.get(), []
    token = _scopes.set((*outer, own))

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _scopes.set(outer)
        try:
            return materialize(df, name)
        finally:
            _scopes.reset(inside)

    try:
        yield keep
    finally:
        _scopes.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
