"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_SIZE = "4m"


def build_session(app: str = "ticketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` (a__b -> a.b) wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder.

    That is ``spark.checkpoint.dir`` or what the application set as checkpoint folder. Only a session
    whose executors are threads of this process may do without, and then uses a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(tempfile.gettempdir(), "ticketloom-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and freezes the partition layout."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (as ``schema``, if its types differ).

    Used where several later stages read the same intermediate table: columnar files keep column
    pruning and filter pushdown, which a row checkpoint would lose.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Delete the files of shuffles that no DataFrame holds any more.

    Spark deletes them once a collection of the driver's whole heap finds them unreachable. A job may end
    before one happens, and until then the files of all its steps add up.
    """
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = BATCH_SIZE) -> None:
    """From now on, Arrow batches of this session hold about ``size`` at most, unless the session was given a limit.

    A batch is held outside the heap by the JVM, while it grows there twice, and by Python. By default it
    has 10,000 rows up to 64 MB, which is 50 MB of whole texts for each of them.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, size)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add ``columns`` so that later filters and joins read their values.

    A filter, or the not-null test of a join, moves below a plain projection and takes the expression
    along, once for every place where the column is used. It stays above a generator, here of one row.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
