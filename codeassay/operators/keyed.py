"""Tables of one row a key, merged by rewriting only the buckets that new rows fall into.

Rows lie in folders by a hash of their key.  An upsert reads the folders that
its keys need, keeps the newest row of each key and replaces just those folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.session import cut_lineage

#: Files that a bucket may get from one upsert.
FILES = 4


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` with one row a key: of rows with one key the greatest by ``newest`` holds, of equals the greatest by all columns.

    The number of buckets belongs to the table and must stay.  Null keys are a
    key.  The key columns and ``newest`` must not be maps.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...]
    newest: str
    buckets: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket")

    def create(self, spark: SparkSession) -> "KeyedTable":
        """An empty table; one that is there stays as it is."""
        spark.createDataFrame([], self._stored()).write.mode("ignore").partitionBy("_bucket").parquet(self.path)
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return self._folders(spark).drop("_bucket")

    def upsert(self, rows: DataFrame) -> int:
        """Merges ``rows`` and returns how many buckets were rewritten.

        The merged buckets are stored before any folder is replaced, so a lost
        executor costs a retry; an upsert that broke off may be repeated.  One
        writer at a time.
        """
        spark = rows.sparkSession
        fresh = cut_lineage(self._newest(rows.select(*self.schema.names, self.bucket())))
        touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            old = self._folders(spark).filter(F.col("_bucket").isin(touched))
            merged = cut_lineage(self._newest(old.unionByName(fresh)))
            salt = F.pmod(F.xxhash64(F.lit("file"), *self.keys), F.lit(FILES))
            spread = merged.repartition(F.col("_bucket"), salt)
            spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        return len(touched)

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_bucket", IntegerType())])

    def _folders(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._stored()).parquet(self.path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys and c != self.newest]
        best = F.max(F.struct(self.newest, *rest)).alias("_x")
        one = rows.groupBy(*self.keys, "_bucket").agg(best)
        return one.select(*[F.col(c) if c in self.keys else F.col("_x")[c].alias(c) for c in self.schema.names], "_bucket")
