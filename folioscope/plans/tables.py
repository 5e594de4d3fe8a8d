"""Session, shared folder and input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "folioscope") -> SparkSession:
    """A session with adaptive execution, in UTC; everything else is the cluster's."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


#: what one Arrow batch holds at most, since texts may be very long
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, alike for every operator; a lower bound of the caller stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        set_to = int(spark.conf.get(key).rstrip("b"))
        if not 0 < set_to <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, and the master is local, a folder below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, written with the options: its lineage is cut, and lost executors cost nothing.

    The table goes as the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave and that nothing will read again."""
    for df in tables:
        fs, at = _file(df.sparkSession, df.written_at)
        fs.delete(at, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
