"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent on one machine (tests), a temporary folder is made and used for checkpoints too;
    on a cluster that is an error, as executors couldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it again: a cut in the lineage
    that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` made, once nothing reads it any more."""
    spark, path = df.sparkSession, df._stored_at
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is stored by now; otherwise they stay until the driver
    happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (for small frames of iterative work)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, starting at 0) and the UTF-8 bytes of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def byte_windows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` bytes together; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def map_texts(df: DataFrame, text: str, keep: list[str], results: str, scan: Callable, with_text: str | None = None) -> DataFrame:
    """Row-wise operator on a text column, in Arrow batches.

    ``scan()`` runs once per task and returns ``f(column) -> list of arrays``, one for each field of
    the DDL string ``results``. The columns ``keep`` pass through; one that has the name of a result
    is replaced by it. The text itself passes through under the name ``with_text``, if given; a column of
    that name in ``keep`` is left out.
    """
    schema = T._parse_datatype_string(results)
    names = {f.name for f in schema.fields}
    keep = [c for c in keep if c not in names and c != with_text]
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    own = [T.StructField(with_text, T.StringType())] if with_text else []
    out = T.StructType([*(source.schema[c] for c in keep), *own, *schema.fields])
    fields = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scan()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            got = f(column)
            arrays = [*(batch.column(i) for i in range(len(keep) + bool(own))), *(x if isinstance(x, pa.Array) else pa.array(x) for x in got)]
            yield pa.RecordBatch.from_arrays(arrays, fields)

    return source.mapInArrow(run, out)
