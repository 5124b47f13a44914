"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Forcing the skew join lets the adaptive planner split a hot join partition even
# when that costs one more exchange above the join; without skew the plan stays
# as it is. The broadcast limit stays at Spark's default: it is compared with the
# size of compressed files, so a larger one would broadcast millions of rows.
PLANNER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Rows of orders and items take some twenty times the bytes of their compressed
# shuffle blocks once a task sorts and counts them, so tasks read less than Spark's
# 64 MB each. A size that was set for the session, also while it runs, is kept.
TASK_SIZE = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the planner settings the submitter did not choose explicitly."""
    submitted = spark.sparkContext.getConf()
    for key, value in PLANNER_SETTINGS.items():
        if not submitted.contains(key):
            spark.conf.set(key, value)
    for key, value in TASK_SIZE.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(app: str, cores: str = "*", **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in {**PLANNER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's checkpoint folder.

    Only a local session may fall back to a temporary folder of its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="martlens-"))
    return context.getCheckpointDir().rstrip("/")


def _staging_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/martlens-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later passes
    column pruning and true size statistics.
    """
    spark = df.sparkSession
    path = f"{_staging_path(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_drops = 0


def drop_written(spark: SparkSession) -> None:
    """Delete every table this application wrote with :func:`written`."""
    global _drops
    _drops += 1
    remove_folder(spark, _staging_path(spark))


def drops() -> int:
    """How often written tables were deleted; those of an earlier count are gone."""
    return _drops


def hadoop_path(spark: SparkSession, folder: str):
    """A path and the file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system, if it is there."""
    path, system = hadoop_path(spark, folder)
    if system.exists(path):
        system.delete(path, True)


def file_stamps(spark: SparkSession, folder: str) -> tuple:
    """Path, time and size of every file below a folder of any file system."""
    path, system = hadoop_path(spark, folder)
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getModificationTime(), file.getLen()))
    return tuple(sorted(found))
