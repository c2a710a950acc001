"""Snapshots on a shared file system: immutable Parquet folders, and one small manifest per version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A statement reads version n and commits n + 1: it writes new folders, then a manifest that names all live ones.

    A manifest appears whole or not at all; what a failed statement wrote is never named. Two writers that commit the same
    version collide on its folder, and the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        try:
            rows = self.spark.read.schema("state string, version int").json(f"{self.root}/manifest").select("version").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(r.version for r in rows)

    def load(self, version: int | None = None) -> tuple[int, dict]:
        """The newest (or a given) version and its state; version 0 is empty."""
        have = self.versions()
        if not have:
            return 0, {}
        at = have[-1] if version is None else version
        row = self.spark.read.schema("state string").json(f"{self.root}/manifest/version={at}").first()
        return at, json.loads(row.state)

    def commit(self, version: int, state: dict) -> None:
        one = self.spark.createDataFrame([(json.dumps(state),)], "state string")
        one.coalesce(1).write.mode("errorifexists").json(f"{self.root}/manifest/version={version}")

    def write(self, df: DataFrame, table: str) -> str:
        path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Change feed between two snapshots of a table: op (insert, update, delete) with the row as it is now, or was last."""
    columns = [c for c in after.columns if c not in key]
    row = lambda df, name: df.select(*key, F.struct(*columns).alias(name))
    both = row(before, "was").join(row(after, "now"), key, "full")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
    return both.withColumn("op", op).where("op is not null").select("op", *key, F.coalesce("now", "was").alias("row")).select("op", *key, "row.*")
