"""Session helpers: a tuned local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "partflow", cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A single-machine session. On a cluster the caller brings a configured session instead."""
    partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go when nothing refers to them
        .config("spark.sql.codegen.maxFields", "400")  # station tables are wider than the default 100
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local[*] session without that setting gets a temporary folder; a cluster session without it
    is an error, because a folder on one machine would not survive the loss of that machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-partflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; callers never reuse or overwrite one."""
    return f"{shared_dir(spark).rstrip('/')}/partflow/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows once, so later passes agree even after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


ROWS_A_TASK = 1 << 20  # rows that a task of a large shuffle takes, whatever the number of rows in all


def tasks_for(df: DataFrame, rows: int = ROWS_A_TASK) -> int | None:
    """How many tasks a shuffle of the rows of a table needs; nothing where the session's own number is enough. The rows of a
    scan are counted from the footers of its files."""
    wanted = -(-df.count() // rows)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """Rows dealt by a key over that many tasks, or as the session has it, so that AQE may still join small ones."""
    return df.repartition(key) if tasks is None else df.repartition(tasks, key)
