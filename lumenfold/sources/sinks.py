"""Sinks: CSV in a fixed column order, JSON lines, tables, manifests and DDL from schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators import integrity
from lumenfold.storage import removed


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in this order; those that aren't there are empty, others are left out."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Atomic overwrite, partitioned by ``by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def normalised_copy(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed to canonical names in source order; a repeated name gets ``__2``, ``__3`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = names.get(c, c)
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(f"`{c}`").alias(name if seen[name] == 1 else f"{name}__{seen[name]}"))
    return df.select(*out)


def numeric_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Text columns cast to the types given; what isn't such a number becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS {t})") for c, t in columns.items()})


_SQL = {T.StringType: "text", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double precision", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp", T.BinaryType: "bytea"}


def _sql_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return _sql_type(kind.elementType) + "[]"
    return "jsonb" if isinstance(kind, T.StructType | T.MapType) else _SQL.get(type(kind), "text")


def ddl(name: str, schema: T.StructType, key: str | None = None, references: dict[str, tuple[str, str]] | None = None) -> str:
    """CREATE TABLE of a schema. references: for a column the table and the column that it points to."""
    rows = [f"  {f.name} {_sql_type(f.dataType)}" + (" PRIMARY KEY" if f.name == key else "") for f in schema.fields]
    rows += [f"  FOREIGN KEY ({c}) REFERENCES {table} ({target})" for c, (table, target) in (references or {}).items()]
    return f"CREATE TABLE {name} (\n" + ",\n".join(rows) + "\n);"


def manifest(tables: dict[str, DataFrame]) -> list[tuple[str, int, int]]:
    """(table, columns, rows) of each table."""
    return [(name, len(df.columns), df.count()) for name, df in sorted(tables.items())]


def save_audit(report: DataFrame, path: str, audit_id: str) -> None:
    """An audit's decisions as JSON, in a folder of its own; saving again replaces it."""
    report.withColumn("audit_id", F.lit(audit_id)).write.mode("overwrite").json(f"{path}/audit={audit_id}")


def load_audits(spark: SparkSession, path: str, schema: T.StructType, audit_id: str | None = None) -> DataFrame:
    """The saved audits, or one of them; the folder is the filter."""
    found = spark.read.schema(schema).json(path)
    return found.where(F.col("audit") == audit_id) if audit_id else found


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version of a set of tables that stands: the last that was published."""
    at, store = _file(spark, f"{path}/current")
    names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
    return max(names, default=None)


def load_tables(tables: dict[str, DataFrame], path: str, keys: dict[str, str], references: list[tuple[str, str, str]] = ()) -> str:
    """Write all tables as a new version, check it, and only then let it stand in place of the one before; return its name.

    Empty texts become null. keys: each table's key, which must be filled and unique. references: (table,
    column, other table): filled values must be keys of the other. A version that fails is deleted, the
    facts are in the error, and readers keep the version that stands. The one before stays until the next.
    """
    spark = next(iter(tables.values())).sparkSession
    old = current_version(spark, path)
    new = f"{int(old or 0) + 1:08d}"
    at = f"{path}/versions/{new}"
    for name, df in tables.items():
        texts = {c: F.when(F.trim(c) != "", F.col(c)) for c, kind in df.dtypes if kind == "string"}
        df.withColumns(texts).write.mode("overwrite").parquet(f"{at}/{name}")
    held = {name: spark.read.schema(df.schema).parquet(f"{at}/{name}") for name, df in tables.items()}
    checks = [integrity.key_check(held[t], t, k).where("blank_keys > 0 OR repeated_keys > 0").select(F.concat(F.lit(f"{t}.{k}: "), F.col("blank_keys").cast("string"), F.lit(" blank, "), F.col("repeated_keys").cast("string"), F.lit(" repeated")).alias("fault")) for t, k in keys.items()]
    checks += [integrity.orphan_check(held[t], c, held[other], keys[other], f"{t}.{c}").where("orphan_rows > 0").select(F.concat("reference", F.lit(": "), F.col("orphan_rows").cast("string"), F.lit(" rows point to nothing")).alias("fault")) for t, c, other in references]
    faults = sorted(r["fault"] for r in integrity.union_all(checks).collect()) if checks else []  # a row a check
    if faults:
        removed(spark, at)
        raise ValueError("; ".join(faults))
    mark, store = _file(spark, f"{path}/current/{new}")
    store.create(mark, True).close()
    versions, _ = _file(spark, f"{path}/versions")
    stale = [x.getPath().getName() for x in store.listStatus(versions) if x.getPath().getName() not in (new, old)]
    removed(spark, *[f"{path}/versions/{v}" for v in stale], *[f"{path}/current/{v}" for v in stale])
    return new


def loaded(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that stands."""
    return spark.read.parquet(f"{path}/versions/{current_version(spark, path)}/{name}")
