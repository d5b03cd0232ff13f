"""Helpers shared by the corpus operators: table reading, shared-folder tables, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenfold.storage import BROADCAST_BYTES, bounded, discarded, met, scratch, settled, shared_dir, written

__all__ = ["BROADCAST_BYTES", "SPACE", "bounded", "discarded", "drop_clashing", "met", "nested", "row_schema", "scratch", "settled", "shared_dir", "table", "text_or_empty", "written"]

#: Word separators: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def nested(docs: DataFrame, without: str | None = None, **others: Column) -> DataFrame:
    """The columns of ``docs``, but ``without``, in one struct ``row`` beside ``others``: no name of the user's meets one of ours."""
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != without]
    own = own or [F.lit(None).cast("int").alias("nothing")]
    return docs.select(F.struct(*own).alias("row"), *[c.alias(name) for name, c in others.items()])


def row_schema(df: DataFrame, others: str = "") -> StructType:
    """The schema of ``row`` of ``df`` and of other columns, for Arrow functions."""
    return StructType([df.schema["row"], *(StructType.fromDDL(others).fields if others else [])])


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns of ``df`` that an operator is about to add (names compare as Spark does)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
