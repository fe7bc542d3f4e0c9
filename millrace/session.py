"""Session, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}
_paths: dict[int, str] = {}
_scopes: list[list[str]] = []


def local_session(cpus: int = 8, shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a data directory, pruned to the named columns."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores where its row groups leave three quarters of them idle; any larger one as it lies.

    For work that is heavy per row. What is shuffled is then less than one row group for four cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without and gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        if sc.applicationId not in _made:
            _made[sc.applicationId] = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, _made[sc.applicationId], ignore_errors=True)
        at = f"file://{_made[sc.applicationId]}"
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder is the cluster's to clear
        pass


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside goes when the block ends: for drivers that live long and run many queries.

    ``with scratch(spark): query(spark, root).write.parquet(target)``
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            _remove(spark, path)


#: Whether Spark drops an execution's shuffle files as it ends.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str, sweep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a checkpoint, survives the loss of executors, keeps column pruning and
    gives the planner true sizes. Used where a result is read more than once. With ``sweep`` the
    shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_SWEEP, None)
    try:
        if sweep:
            spark.conf.set(_SWEEP, "true")
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``saved``, with the number of rows as the write counted them, which saves a job."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def is_saved(df: DataFrame) -> bool:
    """Whether ``df`` is what ``saved`` gave back."""
    return id(df) in _paths


def release(df: DataFrame) -> None:
    """Remove what ``saved`` wrote for ``df``, once nothing still to run reads it."""
    path = _paths.pop(id(df), None)
    if path:
        _remove(df.sparkSession, path)
