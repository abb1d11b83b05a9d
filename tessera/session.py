"""Session factory used by the bench, the tests and local runs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own
    configuration where they are not given.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=conf | (extra or {})).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where the setting is absent, a local session takes a folder below its
    warehouse; on a cluster that would be a machine's own disk, so it fails.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


class Folder:
    """A folder of its own in the shared folder. It is removed when the session's application ends, with what it holds."""

    def __init__(self, spark: SparkSession, name: str):
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.root)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)

    def path(self, name: str) -> str:
        """A place in the folder."""
        return f"{self.root}/{name}"
