"""Session helpers: settings for tests and local runs, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that ``bounded_broadcast`` will ship to every executor.
BROADCAST_ROWS = 200_000
#: Largest scan that ``spread`` shuffles.
SPREAD_BYTES = 256 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench: UTC, AQE on, few shuffle partitions, and the settings of ``tune``."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fundspark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    tune(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a context, so that their Python workers can import it wherever they run.

    The archive is made on the driver, served by it (``addPyFile``) and removed when it ends.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fundspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="fundspark-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / "fundspark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"fundspark/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._fundspark_shipped = True


def bounded_broadcast(df: DataFrame, bound: DataFrame | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    ``bound`` is a frame with at least as many rows that is cheaper to count
    (the table that ``df`` groups: its count is read from the file footers). The count stops after ``max_rows + 1`` rows. Beyond
    the bound the join is a shuffled one, where AQE splits skewed partitions. Callers pass only a few
    short columns, so the bound on rows is one on bytes too.
    """
    return F.broadcast(df) if (df if bound is None else bound.select()).limit(max_rows + 1).count() <= max_rows else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``bounded_broadcast`` of a computed side: it is kept, so that the check of its size doesn't compute it twice."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is a small scan of fewer parts than there are (a small file of one row group), else as it is.

    Row-wise work that costs much more than reading is then not left to one
    task. What is shuffled is at most SPREAD_BYTES whatever the cluster; a scan above that is never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if max(len(df.inputFiles()), size // part) < cores else df


def tune(spark: SparkSession) -> None:
    """Settings of a session in which NAV rows are parsed; for the application to call, no operator does.

    Spark may leave a fused stage whose compiled method HotSpot wouldn't
    compile (over 8000 bytes of bytecode); interpreted it takes twice the time
    of the unfused form. Dynamic partition pruning, of no use on tables that aren't
    partitioned, follows every alias of a join key down the plan, which takes seconds for keys that are parsed from text.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
