"""Session helpers: local sessions for tests, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benches; a cluster brings its own."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": "lectern",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("LECTERN_DRIVER_MEMORY", "6g"),
        "spark.sql.maxMetadataStringLength": "2000",
        **conf,
    }
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: `spark.checkpoint.dir` as the cluster names it.

    Only a plain local session may go without the setting; it then gets a temporary folder. On a
    cluster a machine-local folder would lose data with its machine, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` whose readers have written their own results; others are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A scanned table, its rows dealt out to all cores if its files have at most `most` bytes: they may be one row group,
    which is one task however many cores there are. Larger tables stay as they are. For plain scans."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) <= most else df


#: Rows of a whole table that one task sorts or joins.
TASK_ROWS = 500_000


def by_key(*sides: tuple[DataFrame, str]) -> list[DataFrame]:
    """Scanned tables, the largest first, each dealt out by its key for a join: a task has about TASK_ROWS rows of the first, so its
    memory doesn't grow with the tables. If that makes no more tasks than cores, they stay as they are. Rows are counted by the files' footers."""
    first = sides[0][0]
    tasks = -(-first.count() // TASK_ROWS)
    if tasks <= first.sparkSession.sparkContext.defaultParallelism:
        return [df for df, _ in sides]
    return [df.repartition(tasks, key) for df, key in sides]


#: Rows and bytes in one Arrow batch: with long texts, Spark's defaults take a Python worker far more than its work does.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from here on its session hands at most BATCH_ROWS rows, and about BATCH_BYTES bytes, at once to Python."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df
