"""What the training-data operators share: shared-folder tables, bounded Arrow batches, byte-exact words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts are long, so batches are kept short; the byte bound guards very long texts.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for tables between steps: ``spark.checkpoint.dir``, or that of ``setCheckpointDir``.

    A folder of our own serves only where both are unset and the master is local; a cluster without a shared folder is refused,
    since its executors would write to their own disks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="factweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(f"file://{own}/rdd")
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (double underscores for dots) that are put back at the end."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a form that survives the loss of executors: any executor, or the driver after a restart of a
    stage, reads the same files. The shuffle files that made the table go as soon as it is written, since nothing reads
    them again; :func:`release` deletes the table when what was made of it is written too.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._factweave_path = path
    return out


def tidy(spark: SparkSession):
    """Shuffle files of actions in this block go when the action ends."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def hash_joins(spark: SparkSession):
    """Shuffled joins run in this block hash a side, without sorting either, if each of its partitions is known to be small."""
    return settings(spark, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold="64m")


def collected(df: DataFrame) -> pa.Table:
    """The rows of a table of a bounded size."""
    with tidy(df.sparkSession):
        return df.toArrow()


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._factweave_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a Python worker holds few texts at a time.

    Plans run after they are made, so these two settings stay in the session; they bound memory and change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: str | Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo ``modulus``; the folds of the contracts. Null ids count as 0 text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row that also tells apart rows without an id or with a repeated id."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def arrow_rows(columns: dict[str, pa.DataType], values: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[k], kind) for k, kind in columns.items()], names=list(columns))
