"""Sessions, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import resource
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_made: dict[str, SparkSession] = {}
_lock, _inside, _found = threading.Lock(), 0, None
#: Removes the shuffle files of a query when it ends; not in every version of Spark.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(cores: str = "8", name: str = "lookalike", **conf: object) -> SparkSession:
    """A local session with the settings that the library is tested with."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one of this process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="lookalike-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers: once per application, unless PYTHONPATH has it."""
    sc, root = spark.sparkContext, Path(__file__).parents[1]
    if sc.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted((root / "lookalike").rglob("*.py")):
            z.write(source, source.relative_to(root))
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lookalike/{sc.applicationId}/lookalike.zip")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(at.toString())
    _shipped.add(sc.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    """For shuffles before work in Python: few bytes there may be much work, so they are not to be coalesced by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame) -> DataFrame:
    """A table as it was read, over at least as many partitions as there are cores: the rows of a small file, which one
    task would read, are dealt out before work in Python. Larger tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files when they end. Threads may be inside at once: the setting that was found is
    put back when the last has left."""
    global _inside, _found
    with _lock:
        _inside += 1
        if _inside == 1:
            try:
                _found = spark.conf.get(CLEAN_UP)  # with a default it would say nothing of settings left as they are
            except Exception:
                _found = None
            if _found is not None:
                spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            _inside -= 1
            if not _inside and _found is not None:
                spark.conf.set(CLEAN_UP, _found)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it back: later steps neither repeat
    its lineage nor depend on any one executor. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lookalike/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(spark):  # the table is written: nothing reads this job's shuffles again
        df.write.parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lookalike/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def result_key(files: DataFrame, *settings: object) -> str:
    """A name that changes with the files (path, size, mtime) in any order, and with the settings, like folders, mode and
    threshold. One combining aggregation."""
    digest = F.md5(F.concat_ws("_", "path", F.col("size").cast("string"), F.col("mtime").cast("string")))
    part = lambda at: F.bit_xor(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint"))
    with shuffles_removed(files.sparkSession):
        state = files.agg(F.count("*"), part(1), part(16)).first()
    return hashlib.md5(repr((tuple(state), settings)).encode(), usedforsecurity=False).hexdigest()


def cached_table(df: DataFrame | Callable[[], DataFrame], key: str, family: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The table stored under a key in the shared folder, made from df if it isn't there yet. The key must
    change with the inputs, as `result_key` does. Of a family, like a mode, only the newest table is kept.
    df may be a function, given with the session: what it stages is only staged if the table isn't there."""
    spark = spark or df.sparkSession
    base = f"{shared_dir(spark)}/lookalike/cache" + (f"/{family}" if family else "")
    path = f"{base}/{key}"
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = to_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(to_path(path + "/_SUCCESS")):
        df = df if isinstance(df, DataFrame) else df()
        with shuffles_removed(spark):
            df.write.mode("overwrite").parquet(path)
        for other in system.listStatus(to_path(base)) if family else ():
            if other.getPath().getName() != key:
                system.delete(other.getPath(), True)
    return (spark.read.schema(df.schema) if isinstance(df, DataFrame) else spark.read).parquet(path)


@contextmanager
def phase(spark: SparkSession, name: str, seconds: dict[str, float] | None = None, memory: dict[str, float] | None = None) -> Iterator[None]:
    """Names the jobs started inside, so that `cancel(spark, name)` ends them, adds up their time, and notes the MB that
    the driver's heap and its Python hold at the end. A stream pauses by stopping: its checkpoint goes on where it was."""
    began = time.monotonic()
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if seconds is not None:
            seconds[name] = seconds.get(name, 0.0) + time.monotonic() - began
        if memory is not None:
            heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
            memory[name] = (heap.totalMemory() - heap.freeMemory()) / 2**20 + resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def drop_staged() -> None:
    """Delete every table that stage_table wrote. Frames that read them must not be used afterwards."""
    for path, spark in list(_made.items()):
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            pass
        _made.pop(path, None)


atexit.register(drop_staged)
