"""Tables, scratch space and small column helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of the contracts: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of whole texts in one Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that any of Spark's file systems can hold."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session without that setting gets a folder of its own; on a cluster it is an error,
    as executors can't read each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_texts(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow`` for rows that hold whole texts: batches of ``BATCH_ROWS`` rows.

    Spark's own number of rows a batch knows nothing of their length; with thousands of pages a
    batch, its copies on both sides would crowd out the task's own memory. The session's setting is
    lowered, never raised.
    """
    spark = df.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return df.mapInArrow(f, schema)


def word_count(text: Column) -> Column:
    """How many runs of non-blanks a text has; a null text has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BLANK_CLASS))).otherwise(0).cast("long")


def hash_pair(*cols: Column) -> list[Column]:
    """128 bits of hash in two longs: collisions stay unlikely beyond 10^12 values."""
    return [F.xxhash64(F.lit("a"), *cols), F.xxhash64(F.lit("b"), *cols)]


def md5_number(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts' text alone; other engines can compute it too."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def code_bytes(batch, name: str) -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes, valid or not."""
    import pyarrow as pa

    return batch.column(name).cast(pa.binary()).to_pylist()
