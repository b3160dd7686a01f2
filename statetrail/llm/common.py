"""What the operators share: tables, stored intermediate results, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most cells of a table that is sent to every executor; above it both sides of a join shuffle.
BROADCAST_CELLS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; set here only on a local master that has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir()


def parts(batches, rows: int = 500):
    """The batches in slices, so that a task makes Python objects of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def freed(run):
    """``run`` for mapInArrow, after which the worker gives back the memory that it no longer needs.

    Workers are used again for the tasks of later stages, and would keep what their largest task took.
    """
    @wraps(run)
    def then_free(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return then_free


class Store:
    """Intermediate tables in a folder of their own below the shared folder.

    A stored table cuts the lineage: what is lost with an executor is read again from there.
    Results read these tables when they are evaluated, so the folder stays until ``remove()``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
        self.count, self.last = 0, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, path: str | None = None) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path or self.base)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, in_arrays: Column | None = None) -> DataFrame:
    """A stored table, to be broadcast if its cells, counted first, are within the limit.

    ``in_arrays`` is how many cells the arrays of a row hold.
    """
    cells = F.count("*") * len(df.columns)
    if in_arrays is not None:
        cells += F.coalesce(F.sum(in_arrays), F.lit(0))
    return F.broadcast(df) if df.agg(cells).first()[0] <= BROADCAST_CELLS else df


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free(name: str, df: DataFrame) -> str:
    """The name, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
