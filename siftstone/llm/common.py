"""Plumbing shared by the operators: shared scratch tables and Arrow helpers."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spaces and the ASCII controls that part words, as bytes.split() has them.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor shares.

    Only where that setting is missing and all runs on one machine is a local
    folder used instead, and it becomes the setting; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftstone/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks it held, not the
    work behind the table.  With `release`, the shuffle files of the finished
    job are freed before the next one starts, for jobs that shuffle much.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    for _ in range(2 * release):  # the context cleaner frees what the collector has found unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and the offsets of its rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows_by(batches, column: str):
    """Groups the rows of Arrow batches, already sorted by `column`, into lists of slices."""

    def slices():
        for batch in batches:
            keys = batch.column(column).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for a, b in itertools.pairwise(cuts):
                yield int(keys[a]), batch.slice(a, b - a)

    for key, group in itertools.groupby(slices(), key=lambda x: x[0]):
        yield key, [x[1] for x in group]


def stretches(sorted_values: np.ndarray):
    """(value, slice) of each stretch of equal values."""
    if len(sorted_values):
        at = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
        for a, b in zip(at, [*at[1:], len(sorted_values)], strict=True):
            yield int(sorted_values[a]), slice(int(a), int(b))


def merge_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; touching spans join."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate(([True], start[1:] > stop[:-1]))
    last = np.concatenate((first[1:], [True]))
    return start[first], stop[last]
