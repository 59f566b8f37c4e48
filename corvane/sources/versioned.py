"""Versioned tables: every change writes a new version folder, one rename publishes it.

Readers see the last published version whole; a writer that fails leaves only
an unpublished folder. Renaming onto an existing version fails, so of two racing
writers one must retry on the other's result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published first, or a row has another revision than expected."""


class VersionedTable:
    """A table with a key, kept in numbered version folders of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        os.makedirs(path, exist_ok=True)

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in os.listdir(self.path) if n[:1] == "v" and n[1:].isdigit())

    def create(self, schema: StructType) -> None:
        """Makes an empty table if there is none."""
        if not self.versions():
            self._publish(self.spark.createDataFrame([], schema), 0)

    def read(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        n = have[-1] if version is None else version
        if n not in have:
            raise KeyError(f"no version {n}")
        return self.spark.read.parquet(f"{self.path}/v{n}")

    def _publish(self, df: DataFrame, base: int) -> int:
        stage = f"{self.path}/.stage-{uuid.uuid4().hex}"
        df.write.parquet(stage)
        try:
            if base + 1 in self.versions():
                raise OSError("published meanwhile")
            os.rename(stage, f"{self.path}/v{base + 1}")
        except OSError as e:
            raise Conflict(str(e)) from e
        return base + 1

    def change(self, how) -> int:
        """Publishes ``how(current rows)``; several changes in one function are one transaction."""
        base = (self.versions() or [0])[-1]
        return self._publish(how(self.read()), base)

    def insert(self, rows: DataFrame) -> int:
        return self.change(lambda now: now.unionByName(rows))

    def upsert(self, rows: DataFrame) -> int:
        """Rows by key replace what is there; of several new rows of a key the last by ``_seq``, if given, wins."""
        if "_seq" in rows.columns:
            w = W.partitionBy(self.key).orderBy(F.desc("_seq"))
            rows = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_seq")
        else:
            rows = rows.dropDuplicates([self.key])
        return self.change(lambda now: now.join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def compare_and_set(self, rows: DataFrame, expected: str = "expected") -> int:
        """Upsert of rows whose expected revision is the current one; any other fails the whole change."""
        now = self.read()
        bad = rows.select(self.key, expected).join(now.select(self.key, "revision"), self.key, "left").filter(
            ~F.coalesce("revision", F.lit(0)).eqNullSafe(F.coalesce(expected, F.lit(0))))
        first = bad.select(self.key).limit(1).collect()
        if first:
            raise Conflict(f"{self.key} {first[0][0]} has another revision")
        return self.upsert(rows.withColumn("revision", F.coalesce(expected, F.lit(0)) + 1).drop(expected))

    def update(self, where: Column, **values: Column) -> int:
        return self.change(lambda now: now.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, where: Column) -> int:
        """Removes the rows for which the condition is true; null keeps a row."""
        return self.change(lambda now: now.filter(~F.coalesce(where, F.lit(False))))

    def delete_ids(self, ids: DataFrame) -> int:
        return self.change(lambda now: now.join(ids.select(self.key).distinct(), self.key, "left_anti"))

    def restore(self, version: int) -> int:
        """A new version with the rows of an old one."""
        old = self.read(version)
        return self.change(lambda _: old)

    def diff(self, a: int, b: int) -> DataFrame:
        """(key, change) between two versions."""
        mark = lambda n, c: self.read(n).select(self.key, F.xxhash64(F.to_json(F.struct("*"))).alias(c))
        j = mark(a, "a").join(mark(b, "b"), self.key, "full")
        kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
        return j.select(self.key, kind.alias("change")).filter(F.col("change").isNotNull())
