"""Session construction and shared-storage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on; an existing session keeps its own values.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfmap", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC time and Arrow transfer on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (a zip of its files)."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfmap_shipped", False):
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(folder):                  # else this copy was itself shipped
        target = os.path.join(tempfile.mkdtemp(prefix="shelfmap-ship-"), "shelfmap.zip")
        with zipfile.ZipFile(target, "w") as z:
            for base, _, files in os.walk(folder):
                for f in sorted(files):
                    if not f.endswith(".pyc"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.join("shelfmap", os.path.relpath(full, folder)))
        sc.addPyFile(target)
    sc._shelfmap_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a local
    master gets a private temporary folder, and a cluster a fresh folder on the
    session's default file system; a default file system that is local to each machine
    is refused there.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root and sc.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="shelfmap-ckpt-")
    if not root:
        home = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration()).getHomeDirectory().toString()
        if home.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{home}/shelfmap-{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared checkpoint folder (set up first if needed).

    A reliable checkpoint survives executor loss; ``localCheckpoint`` would not.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, through the Hadoop file system of the session."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def touch(spark: SparkSession, path: str) -> None:
    """An empty marker file, through the Hadoop file system of the session."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hpath, True).close()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that is read no more, through the Hadoop file system of the session."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextlib.contextmanager
def set_for_now(spark: SparkSession, key: str, value):
    """Within it, the session's setting ``key`` has another value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def brief_shuffles(spark: SparkSession):
    """Within it, a statement's shuffle files go as soon as it ends; for results that are stored and read back."""
    return set_for_now(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def arrow_rows(spark: SparkSession, rows: int):
    """Within it, at most so many rows reach Python at once."""
    return set_for_now(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)
