"""Session-dependent helpers: table reading and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Calendar arithmetic is done in UTC whatever the host's zone is."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session has it: spark.checkpoint.dir or setCheckpointDir."""
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if wanted:
        if current is None:
            sc.setCheckpointDir(wanted)
        return wanted
    if not current:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return current


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under the shared one. It owns the tables that are handed over, and goes with the
    application: what is to stay is written elsewhere."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stratocast-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        files.mkdirs(place)
        files.deleteOnExit(place)
    return path


#: Rows up to which a counted table is sent to every task.
SMALL = 100_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared folder and read back. Unlike a local checkpoint it survives
    the loss of executors; unlike any checkpoint it does not carry the old plan's constraints, which grow
    with every step of an iteration."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
