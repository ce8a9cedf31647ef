"""Session settings for local runs, and durable intermediate results."""

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = 8, name: str = "tallyward", **settings: str
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Call sites of column functions cost more than the functions do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tallyward-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one in local runs without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    # Only in "local" and "local[...]" are driver and executors one process.
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


_written: list[str] = []


def durable(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the cluster's checkpoint folder.

    What reads it does not repeat the work before it, not even when executors
    are lost, and still reads only the columns it needs. The table stays until
    :func:`drop_durable`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(path)
    return spark.read.schema(df.schema).parquet(path)


def written(path: str) -> None:
    """Has :func:`drop_durable` delete the path as well."""
    _written.append(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_durable(spark: SparkSession) -> int:
    """Deletes every table that :func:`durable` has written in this process, and
    says how many. Results that read them cannot be computed any more."""
    count = len(_written)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count
