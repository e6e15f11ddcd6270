"""Sequential numbers over a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import cut


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """``df`` with 1-based numbers in the given order; ties are numbered in some stable order.

    The rows are range-partitioned and sorted, written once, and numbered inside each range; only one count
    per range is summed up for the offsets.
    """
    raw = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, pos = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = raw.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.selectExpr("_part", "coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _off")
    return raw.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_off") + pos + 1).drop("_m", "_part", "_off")
