"""Shared pieces: table access, recoverable intermediate tables, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only in local mode:
    on a cluster a machine-local folder would lose rows with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gaplens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def spent_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a write go when the write is done: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def own_place(spark: SparkSession, name: str) -> str:
    """A new folder of this application; it goes when the application ends, or earlier by hand."""
    where = f"{shared_dir(spark)}/gaplens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, path = _path(spark, where)
    fs.deleteOnExit(path)
    return where


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The folder goes when the application ends, or earlier with ``discard``.
    """
    spark = df.sparkSession
    where = own_place(spark, name)
    with spent_shuffles(spark):
        df.write.parquet(where)
    back = spark.read.schema(df.schema).parquet(where)
    back._stored_at = where
    return back


def discard(*frames: DataFrame | None) -> None:
    """Delete tables made by ``store`` that nothing reads any more."""
    for df in frames:
        where = getattr(df, "_stored_at", None)
        if where:
            fs, path = _path(df.sparkSession, where)
            fs.delete(path, True)


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def per_row(columns: list[str], work: Callable[[dict], dict], schema: pa.Schema, keep: bool = False):
    """A ``mapInArrow`` function: ``work`` gets the named columns of a batch as lists and returns lists.

    Batches are cut to bounded slices of rows, so that long texts don't pile up.
    With ``keep`` the input columns stay in front.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                made = work({c: batch.column(c).to_pylist() for c in columns})
                arrays = [pa.array(made[f.name], f.type) for f in schema]
                if keep:
                    yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *schema.names])
                else:
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run
