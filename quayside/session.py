"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
_SCOPE: ContextVar[str | None] = ContextVar("quayside_scratch", default=None)


def local_session(app: str = "quayside", cpus: int | str = "*") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Intermediate tables written here outlive the executors that made them. Without that
    setting a temporary folder is used in local mode only: on a cluster a machine-local
    folder would not be visible to the other executors. Inside :func:`scratch_scope` it lies below that
    scope's folder.
    """
    root = _SCOPE.get()
    if root:
        return f"{root}/{purpose}-{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            app = context.applicationId
            root = _LOCAL_SCRATCH.setdefault(app, "") or tempfile.mkdtemp(prefix="quayside-")
            _LOCAL_SCRATCH[app] = root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """All intermediate tables made inside lie in one folder, whose path is given and which goes at the end.

    Results read from there as they are computed, so they are written to their own place before the scope ends.
    """
    folder = scratch_folder(spark, "scope")
    outer = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


PACKED = "zstd"  # intermediate tables take a quarter less than with Parquet's usual compression
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it has been written.

    Otherwise they stay until the driver happens to collect its garbage, and those of all steps of a job add up. What was
    written is read from the shared folder from then on, so nothing needs them again.
    """
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


FEW_ROWS = 10_000  # of 4,000 characters each, 40 MB


def sized(rows: DataFrame, count: int) -> DataFrame:
    """Rows as a side of a join: broadcast where they were counted to be few, merged otherwise."""
    return F.broadcast(rows) if count <= FEW_ROWS else rows.hint("merge")


def stored(rows: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Rows written to the shared scratch folder and read back from there.

    A ``path`` named before a :func:`scratch_scope` began stays when that scope's own tables go.
    """
    path = path or scratch_folder(rows.sparkSession, purpose)
    with shuffles_freed(rows.sparkSession):
        rows.write.option("compression", PACKED).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
