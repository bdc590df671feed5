"""Session for tests and benchmarks, and the shared folder for written intermediate tables."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="8", app="kilowatch", **conf):
    """A local session. On a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("KILOWATCH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


# Settings of the session the queries rely on.
SETTINGS = {
    # Zone-less text and timestamp_ntz are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    # First and last per group stay in a hash table up to this many groups per task; beyond, they are sorted.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def prepare(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_folder(spark, purpose):
    """A new folder below the one the cluster names in `spark.checkpoint.dir`.

    Only a local master may fall back to a folder of this machine, and the setting is then recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder all executors share")
        root = tempfile.mkdtemp(prefix="kilowatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
