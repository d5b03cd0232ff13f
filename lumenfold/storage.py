"""Tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 64 << 20

#: Paths written inside the innermost settled call.
_paths: ContextVar[list[str]] = ContextVar("paths", default=[])  # noqa: B039


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, a temporary one for local sessions alone.

    On a cluster executors don't see a driver's own folders, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def bounded(small: DataFrame, row_bytes: int = 32) -> DataFrame:
    """``small`` with a broadcast hint if its rows are few enough, else as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, for work that is heavy for its bytes: a small file would be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def met(rows: DataFrame, facts: DataFrame, key: str, share: int = 1000, row_bytes: int = 64) -> DataFrame:
    """``rows`` inner joined to ``facts`` on ``key``, where one key may hold any part of ``rows``.

    facts: one row a key, with ``n``, how many of ``rows`` have it; ``n`` isn't in the result. Both should be
    written tables. Facts that fit are broadcast. Else keys with over 1 / ``share`` of all rows, so fewer
    than ``share`` keys, are broadcast, and the others, each with so few rows, meet by a shuffle.
    """
    found = facts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found[0] * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts.drop("n")), key)
    hot = F.col("n") * share > found[1]
    many = F.broadcast(facts.where(hot).drop("n"))
    few = rows.join(many.select(key), key, "left_anti").join(facts.where(~hot).drop("n"), key)
    return rows.join(many, key).unionByName(few)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, for files; deleted as tables are that ``written`` makes."""
    path = f"{shared_dir(spark)}/lumenfold-{what}-{uuid.uuid4().hex}"
    _paths.get().append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    The written table outlives a lost executor, so a retried task never recomputes what came before.
    """
    path = _kept(df, what)
    _paths.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept(df: DataFrame, what: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/lumenfold-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables, in whatever store they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discarded(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    own, files = _paths.get(), df.inputFiles()
    found = [p for p in own if any(p.rsplit("/", 1)[1] in f for f in files)]
    removed(df.sparkSession, *found)
    own[:] = [p for p in own if p not in found]


def settled(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write what ``f`` returns, and delete the tables that it wrote on the way.

    For results of a few numbers a row; the result depends on none of the deleted tables.
    """

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        own: list[str] = []
        outer = _paths.set(own)
        try:
            found = f(*args, **kwargs)
            path, spark = _kept(found, f.__name__), found.sparkSession
        finally:
            _paths.reset(outer)
        result = spark.read.schema(found.schema).parquet(path)
        _paths.get().append(path)
        removed(spark, *own)
        return result

    return run
