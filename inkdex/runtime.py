"""Session helpers shared by all operators: tables, shared scratch space, bounded side data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent on a local master (tests, one machine) a folder of our own is made once per session; on
    any other master that is an error, as no folder of the driver's machine would do.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="inkdex-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for any path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file of any file system; one that exists is an error."""
    fs, there = file_system(spark, path)
    out = fs.create(there, False)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file of any file system."""
    fs, there = file_system(spark, path)
    stream = fs.open(there)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there is deleted when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, there = file_system(spark, path)
    fs.deleteOnExit(there)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors.

    Unlike ``checkpoint()`` this computes the rows once and keeps them columnar.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Put ``data`` where every task can memory-map it; returns the name for ``SparkFiles.get``."""
    path = f"{shared_path(spark, 'files')}/{name}"
    write_file(spark, path, data)
    spark.sparkContext.addFile(path)
    return name


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle of the session is spread over at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by key over as many partitions as the session shuffles into.

    For what multiplies the rows or is heavy work on each: adaptive coalescing by their size would leave too few tasks.
    """
    return df.repartition(partitions(df.sparkSession), key)


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """The same, but only where ``df`` is a plain scan in fewer partitions: a small table whose rows are heavy work.

    A large table has more splits than that already, and isn't shuffled.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= partitions(df.sparkSession):
        return df
    return spread(df, key)
