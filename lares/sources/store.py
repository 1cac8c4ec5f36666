"""Derived tables that are replaced as a whole or by part, and read as they were committed.

A write puts its rows under a name of its own and only then adds one row to the table's list of
commits. A reader looks at that list, so it sees a refresh whole or not at all; a job that dies
between both leaves rows that nobody reads, and a rerun simply commits again. Parts (run dates)
are replaced one by one, and a read of some parts opens no others.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COMMIT = "part string, version string, number long"


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self, name: str) -> DataFrame:
        """part, version, number of every commit; empty before the first."""
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.root}/{name}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMIT)

    def current(self, name: str) -> dict[str, str]:
        """The version that each part stands at."""
        last = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("number"), F.desc("version")))
        return {r["part"]: r["version"] for r in self.commits(name).withColumn("_r", last).where("_r = 1").collect()}

    def stage(self, name: str, rows: DataFrame) -> str:
        """Writes rows that nobody sees yet; the name of their version."""
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}/versions/{version}")
        return version

    def commit(self, name: str, version: str, part: str = "all") -> None:
        number = (self.commits(name).agg(F.max("number")).first()[0] or 0) + 1
        row = self.spark.range(1, numPartitions=1).select(F.lit(part).alias("part"), F.lit(version).alias("version"), F.lit(number).cast("long").alias("number"))
        row.write.mode("append").parquet(f"{self.root}/{name}/commits")

    def put(self, name: str, rows: DataFrame, part: str = "all") -> None:
        """Replaces a part (or the whole of a table without parts)."""
        self.commit(name, self.stage(name, rows), part)

    def get(self, name: str, *parts: str) -> DataFrame:
        """The rows of the named parts (of all, if none is named) with the column ``part``."""
        now = self.current(name)
        missing = [p for p in parts if p not in now]
        if missing or not now:
            raise KeyError(f"{name}: no such part: {', '.join(missing) or 'none is committed'}")
        read = lambda p: self.spark.read.parquet(f"{self.root}/{name}/versions/{now[p]}").withColumn("part", F.lit(p))
        return reduce(DataFrame.unionByName, map(read, parts or sorted(now)))

    def before(self, name: str, part: str) -> str | None:
        """The latest part before ``part``, by name (dates as yyyy-mm-dd)."""
        return max((p for p in self.current(name) if p < part), default=None)
