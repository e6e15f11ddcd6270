"""Per-key results on skewed keys by eager aggregation through joins.

Both inputs are reduced to one compact state per join key before anything is joined: a count, sums, the
number of distinct files and the first and last place. Every reduction is a two-phase hash aggregation, so
rows of a hot key are combined where they are read and at most one partial state per map task and key is
shuffled. The join then sees one row per key and side: counts of the join result are products of the two
counts, sums are scaled by the other side's count, minima and maxima pass through. The rolled-up result
equals the one of joining first and grouping afterwards.

Defined results: rows whose key is null join nothing and have no state; repeated rows count as often as they
are stored; an empty input gives an empty result; other columns of the inputs, whatever their names, are
dropped before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, key: str, file: str, place: list[str]) -> DataFrame:
    """One state per value of ``key``: rows, distinct files, first and last place.

    Distinct files come from a first reduction to (key, file), so no task gathers the files of a hot key; the
    second reduction adds up states of the first. ``place`` are the columns that follow ``file`` in a place.
    """
    at = F.struct(F.col(file).alias("file"), *[F.col(c).alias(c) for c in place])
    by_file = (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), F.col(file).alias("file"), at.alias("at"))
        .groupBy("key", "file")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    return by_file.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.count("file").alias("n_files"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def count_states(df: DataFrame, key: str) -> DataFrame:
    """The smallest state: the number of stored rows per key."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))


def joined_states(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two state tables by key and combine them; one row per key on either side.

    ``n_pairs`` is the number of rows the join of the unreduced inputs would have for the key.
    """
    a = left.select("key", *[F.col(c).alias(f"l_{c}") for c in left.columns if c != "key"])
    b = right.select("key", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "key"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return a.join(b, "key", how).withColumn("n_pairs", zero("l_n_rows") * zero("r_n_rows"))


def eager_join_sum(left: DataFrame, right: DataFrame, key: str, value: Column) -> DataFrame:
    """sum(value of left) and count(*) over ``left join right``, per key, without building the join.

    ``value`` is an expression over ``left``. Null values add nothing; a key whose values are all null has
    the sum null, as SQL has it.
    """
    a = (
        left.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), value.alias("v"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    )
    b = count_states(right, key)
    return a.join(b, "key").select("key", (F.col("n") * F.col("n_rows")).alias("n_pairs"), (F.col("s") * F.col("n_rows")).alias("sum_value"))


def hot_keys(states: list[tuple[str, DataFrame]], one_in: int = 50) -> DataFrame:
    """Keys holding more than 1/one_in of all rows of their table: (field, hot_key).

    The rows of a key are held against the rows of its table, a join of the named tables with themselves by
    field, of which only the pre-aggregated states are joined: one row per key on the left, rolled up to one row
    per field on the right (that side has one row per named table, so it is broadcast whatever the data's size).
    Rows with a null key belong to the table, so state tables keep them under a null key.
    """
    tagged = None
    for name, st in states:
        part = st.select(F.lit(name).alias("key"), F.col("key").alias("hot_key"), "n_rows")
        tagged = part if tagged is None else tagged.unionByName(part)
    totals = tagged.groupBy("key").agg(F.sum("n_rows").alias("n_rows"))
    share = joined_states(tagged, F.broadcast(totals))
    return share.filter(F.col("l_hot_key").isNotNull() & (F.col("l_n_rows") * one_in > F.col("r_n_rows"))).select(F.col("key").alias("field"), F.col("l_hot_key").alias("hot_key"))


def table_states(df: DataFrame, key: str) -> DataFrame:
    """Count states that keep the null key, for shares of a whole table."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
