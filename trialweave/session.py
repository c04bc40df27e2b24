"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "trialweave", cores: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    The Arrow kernels are imported there.  Clusters that have the package installed or
    get it by ``--py-files`` lose nothing by it.
    """
    context = spark.sparkContext
    if getattr(context, "_trialweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "trialweave.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for source in sorted(package.rglob("*.py")):
            held.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._trialweave_shipped = True


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``.  Where it is unset a local
    session (tests, benchmarks) takes one temporary folder for its life; any other master
    is refused, because executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context = spark.sparkContext
        root = getattr(context, "_trialweave_scratch", None)
        if root is None:
            root = context._trialweave_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{root.rstrip('/')}/trialweave/{purpose}-{uuid.uuid4().hex}"
    for held in _SCOPES:
        held.append(path)
    return path


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


_SCOPES: list[list[str]] = []


@contextmanager
def job_folders(spark: SparkSession) -> Iterator[list[str]]:
    """Remove every step written inside the block when the block ends.

    Results are lazy and read those steps: write or show them inside the block.
    """
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield held
    finally:
        _SCOPES[:] = [other for other in _SCOPES if other is not held]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in held:
            where = hadoop.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results several later steps read: they start from files that survive a lost
    executor, instead of running the steps before again.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
