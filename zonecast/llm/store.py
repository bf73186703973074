"""Tables handed from one job to the next, in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that names none gets one folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault("folder", tempfile.mkdtemp(prefix="zonecast-llm-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame once and go on from the written table: a lost executor replays nothing before it."""
    spark, path = frame.sparkSession, new_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(frame: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` of text a table makes, as many as shuffle partitions at least."""
    held = frame.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(shuffle_width(frame.sparkSession), -(-held // block_bytes))


def aside(frame: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns out of the way of an operator's ``own`` names, and how to rename them back."""
    taken, back = {name.lower() for name in (*own, *frame.columns)}, {}
    for name in frame.columns:
        if name.lower() in own:
            free = f"{name}_kept"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            back[free] = name
    return frame.withColumnsRenamed({name: free for free, name in back.items()}), back
