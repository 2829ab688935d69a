"""Session settings and the one place that decides where intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Whether a query's shuffle files are deleted when it ends, or when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (local tests) is a temporary folder made, and removed at exit.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="shelfspark-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, keeps columns prunable.

    What was shuffled for it is deleted as soon as it is written: nothing reads that again.
    """
    path = f"{staged_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
