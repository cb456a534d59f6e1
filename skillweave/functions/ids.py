"""Identifiers from texts and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions.text import norm_text


def stable_id(text: Column | str, prefix: str) -> Column:
    """prefix + '-' + 12 hex digits of the SHA-1 of the normalised text."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(norm_text(text)), 1, 12))


def raw_id(text: Column | str, prefix: str = "cv") -> Column:
    """prefix + '-' + 10 hex digits of the SHA-1 of the raw text."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), 1, 10))


def ensure_ids(df: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    """If any id is null, the whole column is made anew from the texts."""
    gaps = df.agg(F.coalesce(F.max(F.col(id_col).isNull().cast("int")), F.lit(0)).alias("gaps"))
    return df.join(F.broadcast(gaps)).withColumn(id_col, F.when(F.col("gaps") == 1, stable_id(text_col, prefix)).otherwise(F.col(id_col))).drop("gaps")


def dense_code(df: DataFrame, key: Column, order: Column, name: str) -> DataFrame:
    """0-based codes of the keys by first appearance under ``order``. Keys are numbered after one
    aggregation; only their (smaller) list is sorted."""
    firsts = df.groupBy(key.alias("k")).agg(F.min(order).alias("o"))
    codes = rank_globally(firsts, [F.col("o"), F.col("k")], name).drop("o")
    return df.join(codes, key.eqNullSafe(F.col("k")), "left").drop("k")


def rank_globally(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position under a total order, without one global task: range partitions are numbered
    on their own and shifted by the sizes of those before."""
    from skillweave.runtime import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("block_", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("block_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("block_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("off_"))
    local = F.row_number().over(Window.partitionBy("block_").orderBy(*order)) - 1
    return ranged.withColumn("pos_", local).join(F.broadcast(offsets), "block_").withColumn(name, (F.col("off_") + F.col("pos_")).cast("long")).drop("block_", "pos_", "off_")


def ordinal_id(group: Column, order: Column, prefix: str = "jd") -> Column:
    """prefix + group + '-cv-' + zero-padded position in the group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return F.concat(F.lit(prefix), group.cast("string"), F.lit("-cv-"), F.lpad(n.cast("string"), 6, "0"))


def draw(*parts: Column | str, sep: str = "|") -> Column:
    """A number from 0 to 2^32 - 1 by the MD5 of the parts; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(sep, *parts)), 1, 8), 16, 10).cast("long")
