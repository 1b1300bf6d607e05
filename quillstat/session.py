"""Session construction and the shared checkpoint folder.

On a cluster the session is built by the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it. Locally (tests, bench) we set our own
under a fresh scratch folder when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages are large strings: keep Arrow batches into mapInPandas modest
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quillstat") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        prepare_session(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUILLSTAT_DRIVER_MEM", "16g"))
    # local build only: a fresh scratch folder for checkpoints (cluster sessions name their own)
    builder = builder.config("spark.checkpoint.dir",
                             tempfile.mkdtemp(prefix="quillstat-ckpt-", dir="/tmp"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the server side owns the checkpoint folder
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the server and all executors share") from None
        return path
    return _ensure_on_context(sc)


def _ensure_on_context(sc) -> str:
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a local session built elsewhere without the setting (tests)
        path = tempfile.mkdtemp(prefix="quillstat-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: what made it runs once, and
    later work does not depend on executors that may be lost."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def prepare_session(spark: SparkSession) -> str:
    """Checkpoint folder + this package on the Python workers; returns the checkpoint folder."""
    path = ensure_checkpoint_dir(spark)
    ship_package(spark, path)
    return path


def ship_package(spark: SparkSession, scratch: str | None = None) -> None:
    """Make ``quillstat`` importable by the Python workers (partition functions and the
    Arrow UDF are pickled by module reference): zip the package once per application and
    add it with ``addPyFile``. Harmless where the package is installed on the executors."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the package must be installed server side
        return
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import quillstat
    pkg = os.path.dirname(os.path.abspath(quillstat.__file__))
    root = os.path.dirname(pkg)
    base = scratch if scratch and "://" not in scratch.replace("file://", "") else None
    if base and base.startswith("file:"):
        base = base[len("file:"):]
    folder = tempfile.mkdtemp(prefix="quillstat-pyfiles-", dir=base if base and os.path.isdir(base) else None)
    zpath = os.path.join(folder, "quillstat.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
