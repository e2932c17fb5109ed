"""Session and scratch-folder helpers shared by the whole package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
#: With it, Spark removes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "tidewrack", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one where that is unset and the executors are on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidewrack-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
    return _LOCAL_SCRATCH[app]


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder under ``scratch_root``."""
    return f"{scratch_root(spark)}/tidewrack/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors: every executor can read
    the files, and nothing lives on one machine's disk. What the write shuffled
    is removed with it, as nothing reads that again.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Rows of the rounds of a loop, a folder a round under one folder; what a round adds is written once, and all rounds are one table."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.count = spark, f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round's rows and read them back."""
        self.schema = df.schema
        self.count += 1
        df.write.parquet(f"{self.path}/{self.count}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.count}")

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


class Dealt:
    """Like ``Rounds``, but dealt into buckets of ``by``, one for each shuffle partition.

    A join on ``by`` with rows that are dealt alike reads a bucket a task and
    shuffles nothing of this table, however many rounds it has. A round has to
    come out of a shuffle, join or grouping on ``by``, so that a task writes one
    bucket. The catalog's entry names a table in the scratch folder.
    """

    def __init__(self, spark: SparkSession, label: str, by: list[str]) -> None:
        self.spark, self.by, self.count = spark, by, 0
        self.name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
        self.path = f"{scratch_folder(spark)}/{self.name}"

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round's rows and read them back."""
        self.count += 1
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.withColumn("_round", F.lit(self.count)).write.mode("append").partitionBy("_round").bucketBy(buckets, *self.by)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            rows.format("parquet").option("path", self.path).saveAsTable(self.name)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.round(self.count)

    def round(self, number: int) -> DataFrame:
        """The rows of one round, from 1."""
        return self.spark.table(self.name).where(F.col("_round") == number).drop("_round")

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        return self.spark.table(self.name).drop("_round")


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; call it once everything that reads it is stored."""
    spark = df.sparkSession
    jvm, own = spark.sparkContext._jvm, scratch_folder(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything that ``materialize`` wrote for this application; call it once results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
