"""Sessions, shared storage and cut lineages."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def session(name: str = "spindrift", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_spindrift_shipped", False):
        sc._spindrift_shipped = True
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spindrift-")) / "spindrift_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode, where it is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named:
        return named
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage and survives lost executors.

    The files go when the driver ends, or before by ``forget``.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/settled-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# An Arrow batch ends at whichever comes first, so one batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


SPREAD_BYTES = 256 << 20  # what is dealt out, at most


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is small, as one file of one row group would be read by one task.

    Told by the optimizer's estimate, so nothing is run; a table over SPREAD_BYTES keeps its partitions,
    and nothing of it is shuffled. What follows is Python work, so its batches are bounded.
    """
    bound_batches(df.sparkSession)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
