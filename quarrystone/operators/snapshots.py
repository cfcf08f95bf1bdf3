"""Stored tables whose mutations rewrite only what they touch.

A snapshot lies in folders by a hash of its keys. A mutation reads the folders that its updates' keys fall into, works
out their next state, keeps that in the shared folder, and then puts it in place by dynamic partition overwrite. Files of
other folders keep their names. A mutation that is stopped in between is run again from the same updates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.storage import forget, stored

PART = "_part"


class Snapshot:
    """A table at `path`, a row's folder being a hash of `keys`, in `parts` folders."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, list(keys), parts
        self.schema = spark.createDataFrame([], schema).schema

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def create(self, df: DataFrame) -> None:
        self._write(df.select(*self.schema.names), "errorifexists")

    def read(self) -> DataFrame:
        return self._all().drop(PART)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self._with_part()).parquet(self.path)

    def _with_part(self):
        from pyspark.sql.types import IntegerType, StructField, StructType

        return StructType([*self.schema.fields, StructField(PART, IntegerType())])

    def _write(self, df: DataFrame, mode: str) -> None:
        rows = df.withColumn(PART, self.part()).repartition(self.parts, PART)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def touched(self, updates: DataFrame, on: Sequence[str] | None = None) -> list[int]:
        """The folders that the updates' keys fall into, at most `parts`. Keys other than the snapshot's are looked up by reading those columns alone."""
        if on is None or list(on) == self.keys:
            found = updates.select(self.part().alias(PART)).distinct()
        else:
            found = self._all().select(*on, PART).join(updates.select(*on).distinct(), list(on), "left_semi").select(PART).distinct()
        return sorted(r[PART] for r in found.collect())

    def mutate(self, updates: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], on: Sequence[str] | None = None) -> list[int]:
        """Replace the touched folders' rows by `change(rows, updates)`; gives the folders. `change` must leave a row's keys as they are."""
        parts = self.touched(updates, on)
        if not parts:
            return parts
        now = stored(change(self._all().where(F.col(PART).isin(parts)).drop(PART), updates).select(*self.schema.names), "snapshot-next")
        left = {r[PART] for r in now.select(self.part().alias(PART)).distinct().collect()}
        if left - set(parts):
            raise ValueError("a mutation moved rows to folders that its updates do not touch")
        self._write(now, "overwrite")
        base = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for p in set(parts) - left:  # no row is left of these, so nothing has overwritten them
            gone = base(f"{self.path}/{PART}={p}")
            gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        forget(now)
        return parts
