"""Session settings the jobs rely on, and cutting long lineages."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Arrivals that one task parses: some seconds of work.
ROWS_PER_TASK = 65_536
# Stored keys are hex texts, which only a codec with entropy coding makes smaller.
COMPRESSION = "zstd"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated JSON key means its last value, as in any JSON object literal.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # The JVM does not compile methods beyond 8000 bytes.  A fused stage that large
    # would run interpreted; unfused projections split their code and stay compiled.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names.

    A machine-local folder is used only when the whole session is one machine and the
    setting is absent; it is remembered here, as a running session cannot be given one.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a shared folder")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="tallyguard-")
    return _own_folders[application]


_own_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, for this session's tables."""
    return f"{shared_dir(spark)}/tallyguard/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several later steps read one expensive result, so that it is computed
    once and a lost executor costs a re-read, not a recomputation.  ``options`` are the
    writer's.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}-{name}"
    df.write.options(**options).parquet(path, compression=COMPRESSION)
    if open_scopes := _scopes():
        open_scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of this thread: each streaming job runs its batches in its own."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`cut` writes inside the block when it ends.

    For jobs that publish their results themselves, such as a micro-batch.
    """
    _scopes().append([])
    try:
        yield
    finally:
        for name in _scopes().pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished rounds left behind, for jobs of many rounds.

    Spark drops shuffle files, broadcasts and plans only once the driver's garbage is collected, and the
    driver's heap otherwise grows before it is.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal a source's rows evenly: a bounded number per task, and work for every core.

    Parsing is the costly step.  Splits of a source go by bytes and row groups, so a split of small
    rows holds millions of them, and how many splits have rows is not known before they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)), key)


def lookup(df: DataFrame, small: DataFrame, key: str, spread_by: str, max_rows: int, salts: int = 64) -> DataFrame:
    """Left join with a table that has one row per ``key``, safe for hot keys.

    Up to ``max_rows`` rows are broadcast.  A larger table is repeated once per salt, so
    the rows of one key are spread over many tasks by a hash of ``spread_by``.
    """
    if small_enough(small, max_rows):
        return df.join(F.broadcast(small), key, "left")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df``, a stored table, holds at most ``max_rows`` rows."""
    return df.count() <= max_rows
