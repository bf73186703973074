"""Session settings and the one place where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "zonecast", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder is not visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a shared folder")
    return _own.setdefault("folder", tempfile.mkdtemp(prefix="zonecast-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own for a table that one job writes and the next one reads."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialize through a reliable checkpoint, so a lost executor does not replay the chain."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Materialize as a compressed table of columns, for rows that are many or read in part; its size is known to joins."""
    spark, path = frame.sparkSession, new_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
