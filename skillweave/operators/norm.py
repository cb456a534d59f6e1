"""Per-group normalisation of scores.

Group statistics are aggregated with map-side combining and joined back, so that a group with a tenth
of all rows is never gathered in one task; ranks are counted in range-partitioned blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.runtime import materialize

TINY = 1e-12


def with_stats(df: DataFrame, group: str, **aggs) -> DataFrame:
    """``df`` with per-group aggregates as further columns; null groups form one group."""
    stats = df.groupBy(F.col(group).alias("g_")).agg(*[c.alias(k) for k, c in aggs.items()])
    return df.join(stats, F.col(group).eqNullSafe(F.col("g_")), "left").drop("g_")


def minmax(df: DataFrame, group: str, x: str, out: str) -> DataFrame:
    """0 in groups of one row and where all are equal."""
    t = with_stats(df, group, lo_=F.min(x), hi_=F.max(x), n_=F.count("*"))
    v = F.when((F.col("n_") <= 1) | (F.col("hi_") - F.col("lo_") <= TINY), 0.0).otherwise((F.col(x) - F.col("lo_")) / (F.col("hi_") - F.col("lo_") + TINY))
    return t.withColumn(out, v).drop("lo_", "hi_", "n_")


def minmax_plain(df: DataFrame, group: str, x: str, out: str) -> DataFrame:
    """(x - min) / (max - min + 1e-12) without special cases."""
    t = with_stats(df, group, lo_=F.min(x), hi_=F.max(x))
    return t.withColumn(out, (F.col(x) - F.col("lo_")) / (F.col("hi_") - F.col("lo_") + TINY)).drop("lo_", "hi_")


def zscore(df: DataFrame, group: str, x: str, out: str) -> DataFrame:
    """By the population deviation; 0 in groups of one row."""
    t = with_stats(df, group, mean_=F.avg(x), sd_=F.stddev_pop(x), n_=F.count("*"))
    return t.withColumn(out, F.when(F.col("n_") <= 1, 0.0).otherwise((F.col(x) - F.col("mean_")) / (F.col("sd_") + TINY))).drop("mean_", "sd_", "n_")


def softmax(df: DataFrame, group: str, x: str, out: str) -> DataFrame:
    t = with_stats(df, group, hi_=F.max(x)).withColumn("e_", F.exp(F.col(x) - F.col("hi_")))
    return with_stats(t, group, sum_=F.sum("e_")).withColumn(out, F.col("e_") / (F.col("sum_") + TINY)).drop("hi_", "e_", "sum_")


def place(df: DataFrame, group: str, order: list, out: str) -> DataFrame:
    """Adds the 0-based position of each row in its group under ``order``, a total order. Rows are range-
    partitioned by group and order, numbered per partition and shifted by the partitions before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = materialize(df.repartitionByRange(parts, F.col(group), *order).withColumn("blk__", F.spark_partition_id()), "places")
    sizes = r.groupBy(F.col(group).alias("grp__"), F.col("blk__").alias("par__")).agg(F.count("*").alias("cnt__"))
    before = Window.partitionBy("grp__").orderBy("par__").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("grp__", "par__", F.coalesce(F.sum("cnt__").over(before), F.lit(0)).alias("off__"))
    local = F.row_number().over(Window.partitionBy(F.col(group), F.col("blk__")).orderBy(*order)) - 1
    j = r.withColumn("pos__", local).join(offsets, F.col(group).eqNullSafe(F.col("grp__")) & (F.col("blk__") == F.col("par__")))
    return j.withColumn(out, (F.col("off__") + F.col("pos__")).cast("long")).drop("grp__", "par__", "off__", "pos__", "blk__")


def rank(df: DataFrame, group: str, x: str, out: str, order: str) -> DataFrame:
    """Ascending positions spread evenly over [0, 1]; ties by ``order``; 0 in groups of one row."""
    t = with_stats(place(df, group, [F.col(x).asc(), F.col(order).asc()], "i_pos"), group, n_=F.count("*"))
    return t.withColumn(out, F.when(F.col("n_") <= 1, 0.0).otherwise(F.col("i_pos") / (F.col("n_") - 1))).drop("i_pos", "n_")


METHODS = {"minmax": minmax, "zscore": zscore, "softmax": softmax}


def normalize(df: DataFrame, method: str, group: str, x: str, out: str, order: str = "row_id") -> DataFrame:
    if method == "none":
        return df.withColumn(out, F.col(x))
    if method == "rank":
        return rank(df, group, x, out, order)
    if method not in METHODS:
        raise ValueError(f"unknown normalisation: {method}")
    return METHODS[method](df, group, x, out)
