"""Durable document stores: where documents survive a restart, and how they come back."""

from __future__ import annotations

import itertools
import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkdex.functions.hashing import storage_shard


class DocumentStore(Protocol):
    """What an engine needs of a store; documents are rows with a ``doc_id``."""

    def storage_shards(self) -> int: ...
    def set(self, docs: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def recover(self) -> DataFrame: ...
    def close(self) -> None: ...


class ParquetStore:
    """A directory of append-only batches, partitioned by storage shard; nothing is ever rewritten on a write.

    mode 'upsert': the latest version of a doc_id counts and a deletion is a later version without a document; 'append':
    every stored row comes back, a deletion removes the latest row of a doc_id. Rows with a null doc_id are refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema, shards: int = 8, mode: str = "upsert"):
        if mode not in ("upsert", "append"):
            raise ValueError("mode must be 'upsert' or 'append'")
        self.spark, self.path, self.schema, self.shards, self.mode = spark, path.rstrip("/"), schema, shards, mode
        self._tick = itertools.count()
        self.schema_on_disk = f"doc_id bigint, doc {schema.simpleString()}, version bigint, place bigint, storage_shard int"

    def storage_shards(self) -> int:
        return self.shards

    def _write(self, rows: DataFrame) -> None:
        version = time.time_ns() // 1000 * 1000 + next(self._tick) % 1000
        rows = rows.withColumns({"version": F.lit(version), "place": F.monotonically_increasing_id(), "storage_shard": storage_shard(F.col("doc_id"), self.shards)})
        rows.write.mode("append").partitionBy("storage_shard").parquet(self.path)

    def set(self, docs: DataFrame) -> None:
        """Stores documents; of a doc_id's repeats within ``docs`` one counts (upsert)."""
        refused = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a document needs a doc_id"))).otherwise(F.col("doc_id"))
        self._write(docs.select(refused.cast("bigint").alias("doc_id"), F.struct(*[docs[f.name] for f in self.schema]).alias("doc")))

    def delete(self, ids: DataFrame) -> None:
        """Deletes documents by ``doc_id``; unknown ones are ignored."""
        self._write(ids.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast(self.schema).alias("doc")))

    def recover(self) -> DataFrame:
        """All stored documents, as rows of the store's schema."""
        rows = self.spark.read.schema(self.schema_on_disk).parquet(self.path) if self._exists() else self.spark.createDataFrame([], self.schema_on_disk)
        latest = Window.partitionBy("storage_shard", "doc_id").orderBy(F.col("version").desc(), F.col("place").desc())
        if self.mode == "upsert":
            rows = rows.withColumn("n", F.row_number().over(latest)).where("n = 1")
        else:  # a deletion takes the nearest stored row before it that no later deletion took
            unbounded = latest.rowsBetween(Window.unboundedPreceding, 0)
            step = F.when(F.col("doc").isNull(), 1).otherwise(-1)
            rows = rows.withColumn("d", F.sum(step).over(unbounded)).withColumn("low", F.min("d").over(unbounded)).withColumn("before", F.coalesce(F.lag("low").over(latest), F.lit(0)))
            rows = rows.where((F.col("d") < F.least("before", F.lit(0))) & F.col("doc").isNotNull())
        return rows.where("doc is not null").select("doc.*")

    def compact(self, path: str) -> ParquetStore:
        """A store at a new path with only what counts; its readers lose nothing while it is written."""
        fresh = ParquetStore(self.spark, path, self.schema, self.shards, self.mode)
        fresh.set(self.recover())
        return fresh

    def _exists(self) -> bool:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there)

    def close(self) -> None:
        """Nothing is open between calls."""


def _version() -> int:
    return time.time_ns()


class JdbcStore:
    """A table of a relational database by Spark's JDBC source; its driver must be on the class path.

    Spark's source can only append, so documents are stored as versions and a deletion is a version without a document;
    ``recover`` takes the latest. The table has the schema's columns, all null in a deletion but doc_id, and two more.
    """

    def __init__(self, spark: SparkSession, url: str, table: str, schema, properties: dict[str, str] | None = None, shards: int = 8):
        self.spark, self.url, self.table, self.schema, self.properties, self.shards = spark, url, table, schema, properties or {}, shards

    def storage_shards(self) -> int:
        return self.shards

    def create(self) -> None:
        """Makes the table if it isn't there."""
        empty = self.spark.createDataFrame([], self.schema).withColumns({"doc_version": F.lit(0).cast("bigint"), "doc_deleted": F.lit(False)})
        empty.write.mode("ignore").jdbc(self.url, self.table, properties=self.properties)

    def set(self, docs: DataFrame) -> None:
        """Upserts by doc_id; of a doc_id's repeats within ``docs`` one counts. Rows with a null doc_id are refused."""
        refused = F.when(F.col("doc_id").isNull(), F.raise_error(F.lit("a document needs a doc_id"))).otherwise(F.col("doc_id"))
        rows = docs.dropDuplicates(["doc_id"]).withColumn("doc_id", refused.cast("bigint")).select(*[f.name for f in self.schema])
        rows.withColumns({"doc_version": F.lit(_version()), "doc_deleted": F.lit(False)}).write.mode("append").jdbc(self.url, self.table, properties=self.properties)

    def delete(self, ids: DataFrame) -> None:
        """Deletes documents by ``doc_id``; unknown ones are ignored."""
        gone = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
        rows = gone.select(*[(F.col("doc_id") if f.name == "doc_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema])
        rows.withColumns({"doc_version": F.lit(_version()), "doc_deleted": F.lit(True)}).write.mode("append").jdbc(self.url, self.table, properties=self.properties)

    def recover(self) -> DataFrame:
        """All stored documents, read in ranges of doc_id, one connection a shard."""
        whole = self.spark.read.jdbc(self.url, self.table, properties=self.properties)
        bounds = whole.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()  # reads the one column
        if bounds.lo is None or bounds.lo == bounds.hi:
            rows = whole
        else:
            rows = self.spark.read.jdbc(self.url, self.table, column="doc_id", lowerBound=bounds.lo, upperBound=bounds.hi + 1, numPartitions=self.shards, properties=self.properties)
        rows = rows.toDF(*[f.name for f in self.schema], "doc_version", "doc_deleted")  # databases change the case of names
        latest = Window.partitionBy("doc_id").orderBy(F.col("doc_version").desc())
        rows = rows.withColumn("n", F.row_number().over(latest)).where("n = 1 and not doc_deleted")
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])

    def close(self) -> None:
        """Connections are Spark's."""


class MongoStore:
    """A collection by the public Mongo connector, where the session has it.

    The connector can't delete, so a deletion upserts a tombstone, which recovery leaves out and a later document replaces.
    """

    def __init__(self, spark: SparkSession, uri: str, database: str, collection: str, shards: int = 8):
        self.spark, self.options, self.shards = spark, {"connection.uri": uri, "database": database, "collection": collection}, shards

    def storage_shards(self) -> int:
        return self.shards

    def set(self, docs: DataFrame) -> None:
        """Upserts by doc_id."""
        docs.write.format("mongodb").options(**self.options, operationType="replace", idFieldList="doc_id").mode("append").save()

    def delete(self, ids: DataFrame) -> None:
        self.set(ids.select("doc_id").where("doc_id is not null").distinct().withColumn("_deleted", F.lit(True)))

    def recover(self) -> DataFrame:
        # left out by the database, so that no schema is told from tombstones
        live = {"aggregation.pipeline": '{"$match": {"_deleted": {"$ne": true}}}'}
        return self.spark.read.format("mongodb").options(**self.options, **live).load()

    def close(self) -> None:
        """Connections are the connector's."""
