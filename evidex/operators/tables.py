"""Reading, writing and changing the tables of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEFAULTS, KEYS, TABLES


def dataset_path(root: str, dataset: str = "main") -> str:
    """Each data set has a folder of its own."""
    return f"{root.rstrip('/')}/{dataset}"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of ``table``; what is missing takes its default."""
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    have = set(df.columns)
    given = lambda f: F.col(f.name) if f.name in have else F.lit(DEFAULTS[table].get(f.name))
    return df.select(*(given(f).cast(f.dataType).alias(f.name) for f in schema))


def replace_rows(current: DataFrame, new: DataFrame, key: str, unique: str | None = None) -> DataFrame:
    """Insert or replace: rows that share the key, or the unique column, with a new row go as a whole."""
    kept = current.join(new.select(key).distinct(), key, "left_anti")
    if unique:
        kept = kept.join(new.select(unique).where(F.col(unique).isNotNull()).distinct(), unique, "left_anti")
    return kept.select(*current.columns).unionByName(new, allowMissingColumns=True)


def merge_rows(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Column-wise merge: a new row changes only the columns that it gives."""
    changed = [c for c in new.columns if c != key]
    fresh = new.select(key, F.struct(*changed).alias("_new"))
    joined = current.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
    return joined.select(*(value(c).alias(c) if c in changed else F.col(c) for c in current.columns))


def upsert_registry(current: DataFrame, given: DataFrame) -> DataFrame:
    """The registry of sources after a configuration was loaded: given sources replace their rows, others stay."""
    return replace_rows(conform(current, "sources"), conform(given, "sources"), "id")


def delete_rows(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")


def cascade_delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the events in ``gone`` (column id)."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "from_event"), "from_event", "left_anti")
    return left.join(ids.withColumnRenamed("id", "to_event"), "to_event", "left_anti").select(*edges.columns)


def rebuild(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table from its JSON lines; of rows with one key the last in the file stays."""
    rows = spark.read.schema(spark.createDataFrame([], TABLES[table]).schema).json(f"{folder}/{table}.jsonl")
    if table not in KEYS:
        return rows
    key = KEYS[table]
    order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"))
    last = rows.select(key, F.struct(*rows.columns).alias("row"), order.alias("place")).groupBy(key)
    return conform(last.agg(F.max_by("row", "place").alias("row")).select("row.*"), table)


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every table as JSON lines, keyed ones in order; never empty files over filled ones."""
    spark = next(iter(tables.values())).sparkSession
    if all(t.isEmpty() for t in tables.values()):
        for name in tables:
            try:
                filled = not spark.read.text(f"{folder}/{name}.jsonl").isEmpty()
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                filled = False
            if filled:
                raise ValueError(f"all tables are empty, but {name}.jsonl is not")
    for name, df in tables.items():
        out = df.orderBy(KEYS[name]) if name in KEYS else df
        out.write.mode("overwrite").json(f"{folder}/{name}.jsonl")


def append(df: DataFrame, folder: str, table: str) -> None:
    """Add rows to a log, by run where it has one."""
    writer = df.write.mode("append")
    (writer.partitionBy("run_id") if "run_id" in df.columns else writer).parquet(f"{folder}/{table}")


def add_missing_columns(df: DataFrame, table: str) -> DataFrame:
    """Additive migration: columns that an older table lacks, as nulls."""
    for f in df.sparkSession.createDataFrame([], TABLES[table]).schema:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df
