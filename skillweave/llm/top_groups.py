"""Problem 5: the N best items of every group, by two-stage salted ranking.

Stage one ranks inside (group, subgroup), the subgroup being a hash of the identifier, and keeps N
of each; stage two ranks at most ``salts * N`` survivors of a group. No task sees a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.words import norm_id


def top_n(df: DataFrame, group: Column, score: Column, item: Column, n: int = 5, salts: int = 32) -> DataFrame:
    """(group_key, item_id, score, place): the N items with the highest score, ties by smaller item.

    Rows with a null group, score or item don't count. Repeated (group, item) rows count once, by
    their best score. Groups with fewer than N items come out whole; an empty table gives no rows.
    """
    rows = df.select(group.alias("group_key"), item.alias("item_id"), score.alias("score")).filter(
        F.col("group_key").isNotNull() & F.col("item_id").isNotNull() & F.col("score").isNotNull()
    )
    best = [F.col("score").desc(), F.col("item_id").asc()]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(salts)))
    # equal (group, item) rows share a salt, so that they can be told apart by their neighbour alone
    w1 = Window.partitionBy("group_key", "salt").orderBy(F.col("score").desc(), F.col("item_id").asc())
    first = (
        salted.groupBy("group_key", "salt", "item_id").agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(w1)).filter(F.col("place") <= n).drop("place", "salt")
    )
    w2 = Window.partitionBy("group_key").orderBy(*best)
    return first.withColumn("place", F.row_number().over(w2)).filter(F.col("place") <= n)


def found(train: DataFrame) -> DataFrame:
    t = top_n(train, norm_id("jd_id"), F.col("label"), F.col("row_id"))
    return t.select(F.col("group_key").alias("jd_id"), F.col("item_id").alias("row_id"))
