"""Session settings, shared scratch space and size-checked collection."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app: str = "storytrends",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution (coalescing, skew splitting) and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Batches of long word lists stay small in the Python workers.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of this machine.
    """
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="storytrends-")
        root = _local_scratch
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Unlike a checkpoint this runs the plan once and keeps column pruning; unlike a
    cache it outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote and nothing reads any more."""
    spark = df.sparkSession
    root = scratch_dir(spark).removeprefix("file://")
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Queries delete their shuffle files as they end, not when the driver happens to collect garbage.
SHUFFLES_DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session with other settings for the queries that run inside."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def collect_bounded(df: DataFrame, max_rows: int) -> pa.Table | None:
    """All rows of ``df`` as Arrow if there are at most ``max_rows``, else None.

    The rows are counted first: a limit would send up to ``max_rows`` rows of every
    partition to one task. Write a frame that is costly to compute beforehand.
    """
    return df.toArrow() if df.count() <= max_rows else None


# Parts that a table of a single scan partition is dealt to.
ONE_FILE_PARTS = 8


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash ``df`` by ``key`` if its scan is one partition, whatever the cluster.

    Such a table is at most one split of the reader, and one task would do all the text
    work behind it. Every other table is left as the reader splits it. ``key`` must be
    unique.
    """
    return df if df.rdd.getNumPartitions() > 1 else df.repartition(ONE_FILE_PARTS, key)


def vector_size(df: DataFrame, vector: str) -> int:
    """Length of the first vector; 0 for an empty frame."""
    row = df.select(F.size(vector)).first()
    return row[0] if row else 0
