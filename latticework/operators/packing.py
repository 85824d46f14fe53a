"""Responses packed under a budget of bytes: items in full, then in short, then left out, in the order of their priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed(items: DataFrame, by: list[str], order: list[str | Column], budget: int | str, full: str = "full_bytes", short: str = "short_bytes") -> DataFrame:
    """Items with `level` (full, short, omitted) and `bytes`, by response.

    items: (by, what orders them, full, short). budget: bytes of each response, or the column that says them. The longest
    beginning of a response's items that fits in full is told in full; of the next ones the longest beginning that fits into the
    rest in short is told in short; what follows is omitted. So more important items are never told shorter than less important
    ones. Sizes below one byte count as one, a null budget as none; the order must tell all items of a response apart.

    An item takes a byte at least, so only as many items of a response can be told as its budget has bytes: the others are
    omitted without being summed up, and a response of very many items does not meet in one task.
    """
    limit = F.lit(budget) if isinstance(budget, int) else F.coalesce(F.col(budget), F.lit(0))
    size = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("long")
    df = items.withColumn("_budget", limit.cast("long")).withColumn("_full", size(full)).withColumn("_short", F.least(size(short), size(full)))
    most = df.agg(F.max("_budget")).collect()[0][0] or 0
    ordered = Window.partitionBy(*by).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The first rows of each response are found before they are dealt by response.
    first = df.withColumn("_place", F.row_number().over(ordered)).filter(F.col("_place") <= most)
    first = first.withColumn("_whole", F.sum("_full").over(so_far)).withColumn("_in", F.col("_whole") <= F.col("_budget"))
    used = F.max(F.when(F.col("_in"), F.col("_whole"))).over(Window.partitionBy(*by))
    first = first.withColumn("_rest", F.col("_budget") - F.coalesce(used, F.lit(0)))
    first = first.withColumn("_brief", F.sum(F.when(~F.col("_in"), F.col("_short")).otherwise(0)).over(so_far))
    level = F.when(F.col("_in"), "full").when(F.col("_brief") <= F.col("_rest"), "short")
    first = first.withColumn("level", level).filter("level IS NOT NULL")
    size_told = F.when(F.col("level") == "full", F.col("_full")).otherwise(F.col("_short"))
    return first.withColumn("bytes", size_told).select(*items.columns, "level", "bytes")


def summary(items: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """(by, items, told_full, told_short, omitted, bytes, truncated): exact counts of every response."""
    n = items.groupBy(*by).agg(F.count("*").alias("items"))
    counts = told.groupBy(*by).agg(F.count_if(F.col("level") == "full").alias("told_full"), F.count_if(F.col("level") == "short").alias("told_short"), F.sum("bytes").alias("bytes"))
    out = n.join(counts, by, "left").na.fill(0, ["told_full", "told_short", "bytes"])
    omitted = F.col("items") - F.col("told_full") - F.col("told_short")
    return out.withColumn("omitted", omitted).withColumn("truncated", omitted + F.col("told_short") > 0)
