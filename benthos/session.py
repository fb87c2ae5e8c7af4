"""Session helpers: the local test session, table loading and shared scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local[N] session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("benthos")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this driver has made so far; their number.

    To be called when results that were derived from them are written: what has not been read
    from them yet cannot be read afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path inside the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests,
    one machine) a temporary folder is made and remembered for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.benthos.scratch", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-benthos-")
            spark.conf.set("spark.benthos.scratch", base)
    _MADE.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
