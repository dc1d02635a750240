"""Row numbers, split columns and row limits over any DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.literals import blank_to_null


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its partitions settled, so that every later pass deals the rows alike.

    Each plan of a shuffle samples other bounds of a sort's ranges, and adaptive execution joins
    partitions by the columns that are read; plans over one RDD share its bounds, and the shuffle is run once.
    Scans of files without buckets deal alike anyway and stay as they are, so their columns can be pruned.
    """
    execution = df._jdf.queryExecution()
    if not any(x in execution.executedPlan().toString() for x in ("Exchange", "BatchScan", "Bucketed:")):
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(execution.toRdd(), df._jdf.schema(), False), spark)


def number_rows(df: DataFrame, name: str = "ROWNUM") -> DataFrame:
    """Add contiguous row numbers from 0 in the order of the partitions.

    One pass counts the rows of each partition; only these counts (one for each partition) are
    joined back, broadcast.  Not defined on a stream.
    """
    if df.isStreaming:
        raise ValueError("rows of a stream cannot be numbered: map a key column instead")
    df = settled(df)
    if df.rdd.getNumPartitions() <= 1:
        return df.withColumn(name, F.monotonically_increasing_id())
    tagged = df.withColumn("_gl_id", F.monotonically_increasing_id())
    counts = {r.part: r.n for r in df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    table = df.sparkSession.createDataFrame(offsets, "_gl_part int, _gl_before long")
    at = F.shiftright("_gl_id", 33).cast("int")
    out = tagged.join(F.broadcast(table), at == F.col("_gl_part"))
    return out.withColumn(name, F.col("_gl_before") + F.col("_gl_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_gl_id", "_gl_part", "_gl_before")


def split_column(df: DataFrame, column: str, new: str, separator: str) -> DataFrame:
    """Repeat each row for every part of a column, split at a literal separator, in a new column.

    A missing column adds an empty one; blank parts are null; a null or blank cell keeps its row.
    """
    if column not in df.columns:
        return df.withColumn(new, F.lit(None).cast("string"))
    parts = F.split(F.col(f"`{column}`").cast("string"), re.escape(separator), -1)
    return df.withColumn(new, F.explode_outer(parts)).withColumn(new, blank_to_null(F.col(f"`{new}`")))
