"""Session helpers shared by every operator: code shipping, the shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sentria-ship-"), "sentria_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in {".py", ".tsv", ".json"}:
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in, but only under a local master:
    on a cluster a machine-local folder would be invisible to other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sentria-shared-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sentria-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def setting(spark: SparkSession, key: str, value: object):
    """A setting for plans that run inside; the session's own holds again after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Arrow batches to Python hold at most ``rows`` rows in plans that run inside; the session's own setting holds again after."""
    if rows is None or 0 < int(spark.conf.get(ARROW_ROWS, None) or 0) <= rows:
        yield
        return
    with setting(spark, ARROW_ROWS, rows):
        yield


def freed_shuffles(spark: SparkSession):
    """Shuffle files of each query that runs inside go when it ends, not when the driver happens to collect its garbage."""
    return setting(spark, SHUFFLE_CLEANUP, True)


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    with batches_of(df.sparkSession, batch_rows):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sentria_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_sentria_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: A table of fewer bytes a core is dealt anew before it meets Python; larger ones have splits enough.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is small: a small file is one row group, which one task would read alone.

    The rows are the same either way; a large table is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and df.rdd.getNumPartitions() < 4 * cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
