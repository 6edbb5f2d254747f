"""Session, table access and the shared scratch folder.

Every operator of the package takes and returns DataFrames; nothing here collects data.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "shapelake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster, submit-time settings win over these."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if master and master.startswith("local"):  # one JVM for all tasks
        b = b.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The partition count that the session shuffles into; operators derive bucket counts from it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    folder of its own, which is removed when the driver ends; a cluster without it is an error, as a
    machine-local folder would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shapelake-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a written intermediate table in the shared folder, under the application's own name."""
    return f"{shared_dir(spark)}/shapelake-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete the application's written intermediate tables; for long sessions, once their results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shapelake-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, is computed once, outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, for helper columns beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def blank_to_null(c):
    """Text without outer blanks; blank text becomes null."""
    return F.nullif(F.trim(c), F.lit(""))
