"""Session helpers: checkpoints in the shared folder of the cluster, and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, app: str = "codestrata", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names.

    Where none is named, a temporary one that goes with the process, on a local master only: on a cluster
    each machine would have a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"name a folder that all machines share in {CHECKPOINT_KEY}")
        named = tempfile.mkdtemp(prefix="codestrata-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def cut_clean(df: DataFrame) -> DataFrame:
    """A cut whose shuffle files go as soon as it is written, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    was = conf.get(SHUFFLE_KEY, "false")
    conf.set(SHUFFLE_KEY, "true")
    try:
        return cut(df.select("*"))  # a plan of its own, which is made under the setting and runs once
    finally:
        conf.set(SHUFFLE_KEY, was)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints of what ``cut`` gave, once nothing reads them any more."""
    for df in frames:
        at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
