"""Session defaults and durable intermediate tables.

Iterative operators cut their lineage by writing a compressed Parquet table to the folder that all
executors share (``spark.checkpoint.dir``), so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kindred-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores if a small input has fewer; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Scratch:
    """Tables of one operator run in the shared folder.

    ``save`` writes a DataFrame and returns it read back (its lineage is one scan); ``drop`` removes a table
    that later steps no longer read. What is left goes with ``close``, at the latest when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kindred-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[back] = path
        return back

    def save_counted(self, df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
        """``save``, and how many rows were written (of those for which ``which`` holds); counted by the write itself."""
        seen = Observation()
        counted = F.count(F.lit(1) if which is None else F.when(which, 1))
        return self.save(df.observe(seen, counted.alias("n"))), seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(df, None)
        if path:
            self._delete(path)

    def release(self) -> None:
        """Has the shuffle files of finished jobs deleted, which otherwise stay until the driver happens to collect its garbage."""
        gc.collect()  # Python objects keep theirs in the driver
        try:
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)  # events of the last job hold its plan
        except Exception:  # a busy bus only means that less is freed
            pass
        for _ in range(2):  # what the first one finalises holds plans too
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.1)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
