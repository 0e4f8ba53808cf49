"""Session builder and checkpoint-directory handling.

Operators never create sessions themselves; they take DataFrames. This module
is for scripts, tests and the bench: it pins the settings every operator
relies on (UTC session clock, AQE with skew-join splitting, no UI server).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # file paths in FROM clauses are not tables (free-form SQL is trusted, but scoped)
    "spark.sql.runSQLOnFiles": "false",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "drillspark",
    conf: dict | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    settings = dict(_BASE_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        settings["spark.driver.memory"] = driver_memory
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is. Only when it is unset *and* the session runs in local mode (tests,
    bench, smoke checks) do we create a private scratch folder. On a cluster
    without the setting we refuse, since a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a shared "
                "checkpoint folder on a cluster"
            )
        configured = tempfile.mkdtemp(prefix="drillspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    elif not _is_local(spark) and configured.startswith(("file:", "/")):
        warnings.warn(f"checkpoint folder {configured} must be a file system that all machines mount", stacklevel=2)
    sc.setCheckpointDir(configured)
    return configured


_job_folder: ContextVar[str | None] = ContextVar("drillspark_job_folder", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared on a
    cluster), or under the running job's own folder in it, for intermediate
    tables a job writes and reads back."""
    base = _job_folder.get() or f"{ensure_checkpoint_dir(spark).rstrip('/')}/drillspark-scratch"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job_scratch(spark: SparkSession):
    """Intermediate tables made in the ``with`` block lie in one folder, which
    is removed at its end. Results still to be read must be written elsewhere
    (or collected) inside the block: they read those tables.

        with job_scratch(spark):
            near_duplicate_pairs(...).write.parquet(target)
    """
    folder = scratch_path(spark, "job")
    token = _job_folder.set(folder)
    try:
        yield folder
    finally:
        _job_folder.reset(token)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """The shuffle files of each query in the ``with`` block go when the query ends, not
    when the driver happens to collect its garbage."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def checkpointed(df):
    """Cut the lineage of ``df`` by writing it as a Parquet table into the
    shared checkpoint folder and reading it back.

    One job computes the plan once; later jobs (and any task retried after
    an executor is lost) read the written files instead of recomputing.
    Columnar, compressed files are much cheaper to write and read than the
    row-serialised files of an RDD checkpoint.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.mode("error").parquet(path)
    # the schema is known: reading it back needs no footer-inference job
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def removed(*tables) -> None:
    """Removes the files of ``checkpointed`` tables that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.written_at)


def aggregated(per_key):
    """An aggregate with a row a key, ready to be joined with the rows it is made of.

    Joined as it is, the aggregate lends the join its own exchange, and adaptive
    execution cannot split a key that a third of the rows have. Written first, both
    sides are plain shuffles (or the small one is broadcast), and it can."""
    return checkpointed(per_key)


def join_back(rows, per_key, on, how="inner"):
    """``rows`` joined with ``per_key``, an aggregate of theirs (see ``aggregated``)."""
    return rows.join(aggregated(per_key), on, how)


def spread(df, by):
    """``df`` dealt out by a hash of its column ``by``, for CPU-heavy work per
    row (tokenising whole texts) on inputs stored as a few large row groups.
    Adaptive execution fits the number of partitions to the data."""
    return df.repartition(by)
