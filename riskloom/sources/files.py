"""Reading and writing tables as Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from riskloom.functions.columns import naive_utc
from riskloom.sources.publication import file_system

# Microseconds are spelled out: the CSV writer's own format stops at milliseconds. Blanks at the
# ends of a string are part of it.
WRITE_OPTIONS = {
    "header": "true",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "escape": '"',
}
READ_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "escape": '"',
    "mode": "FAILFAST",
}
# What a time may look like in a file: any number of fraction digits, and a zone or none.
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*(Z|UTC|[+-]\d{2}:?\d{2})?$"


def read_parquet(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv(
    spark: SparkSession, path: str, schema: str, multi_line: bool = False
) -> DataFrame:
    """Read CSV with the given types; a row that does not fit them fails the job.

    Times may have whole seconds or fractions and a zone, in which case they become UTC. Files
    whose strings hold line breaks need ``multi_line``; then a file is read by one task.
    """
    wanted = StructType.fromDDL(schema)
    times = [f.name for f in wanted if f.dataType == TimestampNTZType()]
    as_text = StructType(
        [StructField(f.name, StringType() if f.name in times else f.dataType) for f in wanted]
    )
    rows = spark.read.schema(as_text).options(**READ_OPTIONS, multiLine=multi_line).csv(path)
    for name in times:
        bad = F.concat(F.lit(f"malformed time in column {name}: "), F.col(name))
        fits = F.col(name).isNull() | F.trim(name).rlike(TIME_TEXT)
        rows = rows.withColumn(name, F.when(fits, F.col(name)).otherwise(F.raise_error(bad)))
        rows = naive_utc(rows, name)
    return rows


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header. Empty strings come back as null."""
    df.write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_parquet_by_month(df: DataFrame, path: str, timestamp: str, month: str = "mes") -> None:
    """Write Parquet in one folder per month of ``timestamp``, for reads that prune by time.

    The rebalance hint gathers the rows of a month before the write, so that tasks do not each
    leave a small file in every folder, and splits the months that are too big for one task.
    """
    dated = df.withColumn(month, F.trunc(F.to_date(timestamp), "month"))
    dated.hint("rebalance", month).write.mode("overwrite").partitionBy(month).parquet(path)


def replace_months(df: DataFrame, path: str, month: str, months: list | None) -> None:
    """Write the months of ``df`` and leave the others' folders as they are.

    ``df`` holds all rows of ``months``, or of all months where that is None. A month of them that has no rows
    loses its folder.
    """
    spark = df.sparkSession
    writer = df.hint("rebalance", month).write.mode("overwrite").partitionBy(month)
    if months is None:
        writer.parquet(path)
        return
    folders = [f"{path}/{month}={'__HIVE_DEFAULT_PARTITION__' if m is None else m.isoformat()}" for m in months]
    # Every write names its files anew, so a folder whose files stay got no rows.
    before = {folder: _files(spark, folder) for folder in folders}
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    for folder, had in before.items():
        if had and _files(spark, folder) == had:
            system, gone = file_system(spark, folder)
            system.delete(gone, True)


def _files(spark: SparkSession, folder: str) -> set[str]:
    system, found = file_system(spark, folder)
    if not system.exists(found):
        return set()
    return {status.getPath().getName() for status in system.listStatus(found)}


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = file_system(spark, path)
    return system.exists(folder)


def state(spark: SparkSession, *paths: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of the last change of every file under the paths, to tell whether any changed."""
    found = []
    for path in paths:
        system, folder = file_system(spark, path)
        listed = system.listFiles(folder, True)
        while listed.hasNext():
            file = listed.next()
            found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` available to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df
