"""Reading and writing tables: one call per format, schema given or inferred, pruning left to the scan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Read a file or folder; csv and json want a schema, since inferring one reads the data twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """Write a table, in folders by the values of partition_by if given."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def events_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, its time as a timestamp with time zone so that it can carry a watermark."""
    from pyspark.sql import functions as F

    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(events: DataFrame, arrival: Column) -> DataFrame:
    """The rows of a table as a stream of files, one a batch, in the order of arrival (an integer of each row).

    Each arrival is one file, so it should be a span of rows that one task can write; times of modification, which
    the file source goes by, are set in order. Null arrivals come first.
    """
    spark, path = events.sparkSession, f"{work_folder(events.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    events.withColumn("__arrival", arrival.cast("int")).repartition("__arrival").write.partitionBy("__arrival").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(int(str(f.getPath().getName()).rpartition("=")[2]) if "HIVE" not in f.getPath().getName() else -(1 << 31), f.getPath()) for f in fs.listStatus(root) if f.isDirectory()]
    for k, (_, folder) in enumerate(sorted(found, key=lambda x: x[0])):
        for f in fs.listStatus(folder):
            fs.setTimes(f.getPath(), 1_600_000_000_000 + 60_000 * k, -1)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


_own: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session without it gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
