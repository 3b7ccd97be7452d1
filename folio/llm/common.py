"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts have it: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Java and Python pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a temporary one is set if all runs on this machine; executors
    elsewhere couldn't share it, so on a cluster that is an error."""
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not jsc.isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a copy in the shared folder that survives lost executors; Spark's cleaner removes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles and checkpoints are done with, so that a long operator's files don't pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Spill:
    """A table in the shared folder that an operator writes, reads several times and drops before it returns."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/spill-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files, and let Spark's cleaner see that the shuffles behind them are done with."""
        del self.df
        release(self.spark)
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        shutil.rmtree(parsed.path, ignore_errors=True)
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for ``mapInArrow``; at its end the worker, which Spark keeps for other tasks, gives freed memory back to the system."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def per_row(df: DataFrame, ident: str, text: str, schema: T.StructType, rows: Callable[[list, list], dict[str, list]], setup: Callable[[], Callable] | None = None, binary: bool = False) -> DataFrame:
    """Map (ids, texts) of Arrow batches to columns, without a shuffle.

    Null texts arrive as ``None``. ``rows`` gets at most ``CHUNK`` characters or one row at a time, so memory follows the
    longest text and not the batch. ``setup`` runs once in each task and may return the function to use instead.
    """
    names = schema.fieldNames()
    kinds = [_arrow_type(f.dataType) for f in schema.fields]
    out = pa.schema(list(zip(names, kinds, strict=True)))
    kind = "binary" if binary else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else rows
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1)):
                got = work(ids, texts)
                yield pa.record_batch([pa.array(got[n], type=k) for n, k in zip(names, kinds, strict=True)], schema=out)

    return df.select(F.col(ident).alias("_id"), F.col(text).cast(kind).alias("_text")).mapInArrow(tidy(run), schema)


#: Bytes of text handled at once.
CHUNK = 1 << 20


def chunks(ids: list, texts: pa.Array, most: int | None = None) -> Iterator[tuple[list, list]]:
    """Consecutive rows of at most ``most`` bytes of text (CHUNK by default), one row at least; only these are Python objects at a time."""
    most = most or CHUNK
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield ids[start:i], texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield ids[start:], texts.slice(start).to_pylist()


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}[type(kind)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def no_clash(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns: extra ones, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
