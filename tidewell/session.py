"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidewell").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewell-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that losing an executor loses nothing.

    A checkpoint keeps the planner's estimate of df's size, which each join multiplies: loops use `written` instead.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Like cut_lineage, but as a compressed Parquet table in the same shared folder; for wide rows such as texts.

    The table is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table of a DataFrame that `written` gave and that nothing reads any more, such as a loop's last round."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidewell_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give fewer than half as many splits; with enough files nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewell_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewell-")) / "tidewell.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._tidewell_shipped = True
