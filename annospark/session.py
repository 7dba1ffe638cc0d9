"""Session helpers: configuration used by the tests and the bench, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "annospark") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    A local session that names none (tests, a laptop) gets a temporary folder; any other is refused, since
    each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    named = named or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="annospark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the written copy.

    A lost executor then costs a re-read, not a recomputation, and the copy's known size lets the
    planner choose joins. ``compression`` names a denser codec for tables of long texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/annospark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut_lineage`` into as many buckets of ``key`` as there are shuffle partitions.

    Joins and groups by ``key`` then read the copy without a shuffle. A bucket is read by one task, so no value of ``key`` may hold a
    large share of the rows.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"annospark_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/annospark-{spark.sparkContext.applicationId}/{name}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(f"default.{name}")
    return spark.table(f"default.{name}")


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute rows over all shuffle partitions before work that multiplies them.

    A small input would otherwise arrive as few partitions, however much is computed from each row.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
