"""Sessions with the settings that the results rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "factweave", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE with skew handling, Arrow. ANSI mode stays on; the functions use try_ variants where input may be malformed."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` by Spark's estimate; of a table that was just read, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Up to so many bytes, by Spark's estimate, a table is dealt out to all cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """``df`` dealt out to all cores if it is small: a small file is one row group and so one task, however much each row costs.

    Larger tables are left as they are: their scan has splits enough, and nothing is shuffled.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= limit else df


def shared_folder(spark: SparkSession) -> str:
    """Where tables between jobs are written: ``spark.checkpoint.dir``, or that of ``setCheckpointDir``; a local master gets a folder of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="factweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}/rdd")
        named = context.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts lineage in a form that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/factweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factweave_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._factweave_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
