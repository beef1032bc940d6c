"""Parquet tables of a data directory, the checks made before a side is broadcast, and what is written on the way."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows, and as JSON at most so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows and max_bytes bytes, else df itself, so that the join shuffles.

    The rows are counted with a limit, so a large df costs no full pass.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def _checkpoints(spark: SparkSession) -> str:
    """The folder that all executors share: the session's (spark.checkpoint.dir). Only where none is named and the executors are this machine's, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there, so that what follows doesn't repeat it. Survives the loss of executors."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints, for tables that a query writes and reads again."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
