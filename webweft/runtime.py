"""Session helpers shared by every operator: the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch on its way to a Python worker, about.
BATCH = 1 << 21
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, the CLI and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webweft")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) is a folder of this
    machine made and kept for the life of the session.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("webweft.scratch.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="webweft-")
        spark.conf.set("webweft.scratch.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/webweft/{label}-{uuid.uuid4().hex}"
    fs, hadoop_path = _filesystem(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    fs, hadoop_path = _filesystem(spark, path)
    fs.delete(hadoop_path, True)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand rows to Python in batches of about ``BATCH`` bytes, which bounds
    the buffers that an executor fills outside its heap and those of its workers. A
    setting of the session itself is left as it is."""
    if _BATCH_BYTES in spark.conf.getAll:
        yield
        return
    spark.conf.set(_BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES)


@functools.lru_cache(maxsize=1)
def _malloc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return None


def give_back() -> None:
    """Return to the system what this process has freed: a Python worker outlives its
    tasks, and would keep the most that one of them took."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def lean(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``run``, a function of a group, giving back each time what it has freed."""

    def leaner(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(frame)
        finally:
            give_back()

    return leaner


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as part of the plan. Those that createDataFrame takes from a list pass
    through Python workers of a pool of their own on every executor."""
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, row)) for row in rows], to_arrow_schema(kinds)), kinds)


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once for each application."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(sc, "_webweft_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="webweft-code-"))  # the driver's own; Spark serves the file from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "webweft.zip", "w") as out:
        for path in sorted((root / "webweft").rglob("*.py")) + sorted(root.glob("corpus_pipeline.py")):
            out.write(path, path.relative_to(root))
    sc.addPyFile(str(folder / "webweft.zip"))
    sc._webweft_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
