"""Lineage cuts for driver loops, and numbers over sorted tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folder(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor shares; a local one only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftstone/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared checkpoint folder and read again.

    A round of a loop then starts from a table, and a lost executor costs its
    tasks alone.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables that a loop has made so far: each is written once, and all are read as one folder."""

    def __init__(self, spark, name: str):
        self.spark, self.at, self.n, self.schema = spark, folder(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round and reads it back."""
        self.schema = self.schema or df.schema
        path = f"{self.at}/round{self.n:05d}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.at)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with `name`, its rows' numbers from 0 in the order of `by`, which no two rows share.

    Rows are dealt by ranges and numbered within them; what the driver keeps is
    one count for each range.
    """
    dealt = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    above, rows = 0, []
    for r in counts:
        rows.append((r["_range"], above))
        above += r["n"]
    table = df.sparkSession.createDataFrame(rows, "_range int, _above long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return dealt.join(F.broadcast(table), "_range").withColumn(name, (F.col("_above") + within).cast("long")).drop("_range", "_above")
