"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerloom", cores: int | str = "*", partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """Session for a single machine, with a checkpoint folder of its own unless one is given. On a
    cluster, submit with the cluster's own settings. Small tables are cut into pieces for all cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.minPartitionNum", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.files.openCostInBytes", "65536")
        # the call site of every single column costs more than the column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="ledgerloom-checkpoint-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Have the folder that spark.checkpoint.dir names take the reliable checkpoints. Only a local
    session that names none gets a folder of its own."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a compressed table below the checkpoint folder; readers take the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
