"""Session helpers: shared scratch tables, partition counts, input sizes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (local mode, tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/streamledger-scratch"
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    It cuts the lineage: a lost executor costs the tasks that read the table, not the steps before it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch table that ``materialize`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/tables/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """An aggregate dealt anew without its key. A join by that key then deals both sides itself, and can split the other side where the key is hot."""
    return df.repartition(partitions(df.sparkSession))


def small_batches(df: DataFrame, rows: int = 1024, read: int = 512) -> DataFrame:
    """``df``, whose session sends whole texts to Python workers in batches of at most ``rows`` rows (``arrow.maxRecordsPerBatch``)
    and reads them from Parquet at most ``read`` rows at a time (``columnarReaderBatchSize``).

    The default of 10,000 texts is tens of megabytes in the executor and again in each worker. That of 4,096 read at a time is
    arrays of many megabytes, made anew for each file, for which the JVM takes more heap rather than collect.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        if not 0 < int(conf.get(name)) <= most:
            conf.set(name, most)
    return df


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows, sent as Arrow.

    Spark passes a list of rows through Python workers that mapInArrow does not use: a second daemon on each executor, whose workers stay idle beside the others.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)


@functools.cache
def _thrifty() -> None:
    """From now on large arrays of this worker, Arrow's too, are mapped by themselves: they go back to the system as they are freed."""
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        libc = ctypes.CDLL(None)
        if libc.mallopt(-3, 4 << 20) and libc.mallopt(-1, 16 << 20):  # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD, which glibc else raises to 32 and 64 MB
            pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on for later tasks, and its executor pays for what it keeps."""
    pa.default_memory_pool().release_unused()
    _thrifty()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts, and a little for each row: what tasks have to hold, whatever the files compress to."""
    return df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16), F.lit(0))).first()[0]
