"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; pin the session so casts agree with that.

    Timestamps are written as INT64, because INT96 takes no filter at the scan.
    """
    for name, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"),
    ):
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


#: Bytes of an Arrow batch, about. A batch lies several times in an executor: in the writer,
#: in the Python worker, and both again for each of its cores.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows go to Python in batches of ``BATCH_BYTES``, so that long texts do not fill one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared folder the cluster names.

    Only a local session that names none (tests, a laptop) gets a folder of its own:
    executors on other machines would not see it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sablewatch-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder all executors reach."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike a checkpointed RDD the table has a size, so joins on it can be
    broadcast when that size allows, and columns are pruned at the scan.
    """
    spark = use_utc(df.sparkSession)
    folder = shared_folder(spark, "stage")
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[table] = folder
    return table


#: Where the tables of ``cut_lineage`` lie, as long as they are referred to.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def drop_table(table: DataFrame) -> None:
    """Delete a table of :func:`cut_lineage`; what is read from it has to be written before."""
    drop_folder(table.sparkSession, _FOLDERS.pop(table))


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table of :func:`cut_lineage` for the time inside; then it is deleted."""
    with passing_shuffles(df.sparkSession):
        table = cut_lineage(df)
    try:
        yield table
    finally:
        drop_table(table)


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    usual = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in usual.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def passing_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that run inside delete their shuffle files when they end, and not when the
    driver's memory happens to be collected. A query that runs twice shuffles twice."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


#: Bytes of a shuffle, or of files, that one task reads, about, inside ``shuffle_tasks``.
TASK_BYTES = 16 << 20


@contextmanager
def shuffle_tasks(spark: SparkSession, tasks: int) -> Iterator[None]:
    """At least ``tasks`` shuffle partitions for the jobs that run inside.

    Adaptive execution joins small ones and splits skewed ones to ``TASK_BYTES``, and scans
    take as much: a task then sorts about the same amount whatever the size of the table.
    """
    name = "spark.sql.shuffle.partitions"
    own = {
        name: str(max(int(spark.conf.get(name)), tasks)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
    }
    with _settings(spark, own):
        yield


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
