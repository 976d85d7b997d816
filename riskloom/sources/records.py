"""CSV whose bad rows are set aside with a reason, and whose strings may hold line breaks.

A file with line breaks in strings is still read by many tasks. A line is inside a string if an odd number of
quotes precedes it in its file. Within a split that is a running sum; what comes before the split is one row
per split, summed up over the file's splits. So every line knows its record, and only the lines of records
that have several are brought together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from riskloom.functions.columns import naive_utc
from riskloom.session import durable
from riskloom.sources.files import READ_OPTIONS, TIME_TEXT

# A record of more lines is taken for a quote that was not closed.
MOST_LINES = 1000
REJECTS = "file string, record string, reason string"


class Records(NamedTuple):
    rows: DataFrame
    rejects: DataFrame  # (file, record, reason)


def read_records(
    spark: SparkSession, path: str, schema: str, line_breaks: bool = False, most_lines: int = MOST_LINES
) -> Records:
    """Read CSV with a header and the given types; a row that does not fit them is a reject, never a failure.

    ``reason`` names the first column that does not fit, or says that their number is wrong. With ``line_breaks``
    strings may span lines; quotes must then only occur as CSV has them, around a string and
    doubled within. A record of more than ``most_lines`` lines is one reject, with its first line.
    """
    wanted = StructType.fromDDL(schema)
    texts = ", ".join(f"`{field.name}` string" for field in wanted) + ", _corrupt string"
    options = {**READ_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if line_breaks:
        records, unclosed = whole_records(spark, path, most_lines)
        parsed = F.from_csv("record", F.lit(texts), {**options, "header": "false"})
        strings = records.select("file", "record", parsed.alias("x")).select("file", "record", "x.*")
    else:
        unclosed = spark.createDataFrame([], REJECTS)
        read = spark.read.schema(texts).options(**options).csv(path)
        columns = F.struct(*[field.name for field in wanted])
        strings = read.select(
            F.col("_metadata.file_path").alias("file"), F.coalesce("_corrupt", F.to_csv(columns)).alias("record"), "*"
        )
    judged = strings.withColumn("reason", _reason(wanted))
    rows = judged.where("reason IS NULL")
    for field in wanted:
        if field.dataType == TimestampNTZType():
            rows = naive_utc(rows, field.name)
        else:
            rows = rows.withColumn(field.name, F.col(field.name).cast(field.dataType))
    rejects = judged.where("reason IS NOT NULL").select("file", "record", "reason")
    return Records(rows.select(*wanted.names), rejects.unionByName(unclosed))


def _reason(wanted: StructType) -> Column:
    """Why a row of strings does not fit; null where it does."""
    found = [F.when(F.col("_corrupt").isNotNull(), F.lit("wrong number of columns"))]
    for field in wanted:
        value, kind = F.col(field.name), field.dataType
        if kind == TimestampNTZType():
            fits = F.trim(value).rlike(TIME_TEXT) & F.expr(f"try_cast(`{field.name}` AS timestamp)").isNotNull()
        else:
            fits = F.expr(f"try_cast(`{field.name}` AS {kind.simpleString()})").isNotNull()
        why = F.lit(f"column {field.name}: no {kind.simpleString()}")
        found.append(F.when(value.isNotNull() & ~fits, why))
    return F.coalesce(*found)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value, quotes): the lines of every split in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", "\r$", "")
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        value.alias("value"),
        (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))).alias("quotes"),
    )


def whole_records(spark: SparkSession, path: str, most_lines: int) -> tuple[DataFrame, DataFrame]:
    """(file, record) of every record but the headers, and rejects for records that do not end."""
    of_split = Window.partitionBy("file", "block").orderBy("n")
    before = F.coalesce(
        F.sum("quotes").over(of_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    lines = _lines(spark, path).withColumn("before", before)
    # How many records begin in a split depends on whether it begins inside a string.
    splits = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.count_if(F.col("before") % 2 == 0).alias("outside"),
        F.count_if(F.col("before") % 2 == 1).alias("inside"),
    )
    # One row per split of a file from here on.
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("quotes").over(of_file), F.lit(0)) % 2)
    begun = F.when(F.col("open") == 1, F.col("inside")).otherwise(F.col("outside"))
    splits = splits.withColumn("begun", begun).select(
        "file", "block", "open", F.coalesce(F.sum("begun").over(of_file), F.lit(0)).alias("records")
    )
    begins = (F.col("open") + F.col("before")) % 2 == 0
    ends = (F.col("open") + F.col("before") + F.col("quotes")) % 2 == 0
    so_far = F.sum(begins.cast("bigint")).over(of_split.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.join(durable(splits), ["file", "block"]).select(
        "file", "n", "block", "value",
        (F.col("records") + so_far).alias("number"), (begins & ends).alias("single"),
    )
    numbered = durable(numbered.where("number > 1"))  # the first record of a file is its header
    single = numbered.where("single AND value != ''").select("file", F.col("value").alias("record"))
    parts = numbered.where("NOT single")
    counts = parts.groupBy("file", "number").agg(
        F.count("*").alias("lines"), F.min(F.struct("block", "n", "value")).alias("first")
    )
    counts = durable(counts)
    few = counts.where(F.col("lines") <= most_lines).select("file", "number")
    joined = parts.join(few, ["file", "number"]).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    unclosed = counts.where(F.col("lines") > most_lines).select(
        "file", F.col("first.value").alias("record"), F.lit("a quote is not closed").alias("reason")
    )
    return single.union(joined.select("file", text.alias("record"))), unclosed
