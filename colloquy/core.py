"""What all operators share: reading tables, blank texts, the shared folder, and Python over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ZERO_WIDTH = "᠎​-‏⁠-⁤﻿"
BLANK = rf"(?U)^[\s{ZERO_WIDTH}]*$"
SLICE = 512


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(BLANK)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir; a temporary one only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="colloquy-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/colloquy-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: str, every: int = SLICE) -> DataFrame:
    """fn over each row as a dict; the rows that it gives, in Arrow batches."""
    return map_slices(df, lambda rows: [out for row in rows for out in fn(row)], schema, every)


def map_slices(df: DataFrame, fn: Callable[[list[dict]], Iterable[dict]], schema: str, every: int = SLICE) -> DataFrame:
    """fn over lists of up to `every` rows as dicts."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, every):
                yield pa.RecordBatch.from_pylist(list(fn(batch.slice(at, every).to_pylist())), schema=arrow)

    return df.mapInArrow(run, kind)


def key128(c: Column) -> Column:
    """128 bits that stand for a text: two independent 64-bit hashes."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(0x5EED), c).alias("b"))
