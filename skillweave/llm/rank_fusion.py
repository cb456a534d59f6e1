"""Problem 7: one ranking from several differently scaled scores, by reciprocal rank fusion.

Ranks are exact and distributed: the rows are range-partitioned by (group, score name, score), each
block is ranked on its own, and the sizes of the blocks before it are added. A group that holds a
third of all rows is spread over many blocks, so that no task sees it whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.top_groups import top_n
from skillweave.runtime import materialize


def exact_rank(values: DataFrame, keys: Sequence[str], value: str, weight: str = "n") -> DataFrame:
    """Adds ``rank``: 1 + the weight of all higher values of the same keys (ties share a rank).

    ``values`` must hold each (keys, value) once; ``weight`` is the number of rows it stands for.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(values.repartitionByRange(parts, *keys, F.col(value).desc()).withColumn("block", F.spark_partition_id()), "rank-blocks")
    blocks = ranged.groupBy(*keys, "block").agg(F.sum(weight).alias("size"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = blocks.select(*keys, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "block").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("above", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(offsets, [*keys, "block"]).withColumn("rank", (F.col("offset") + F.col("above") + 1).cast("long")).drop("block", "above", "offset")


def candidates(features: DataFrame, scores: Sequence[str], group: str = "jd_id", item: str = "cv_id") -> DataFrame:
    """(grp, item, one DOUBLE column s0, s1, ... per score), each (group, item) once.

    Rows with a null id, or a null or NaN score don't count. Of rows written again with other scores
    the largest of each score is taken.
    """
    ok = F.col(f"`{group}`").isNotNull() & F.col(f"`{item}`").isNotNull()
    for s in scores:
        ok = ok & F.col(f"`{s}`").isNotNull() & ~F.isnan(F.col(f"`{s}`").cast("double"))
    rows = features.filter(ok).select(F.col(f"`{group}`").alias("grp"), F.col(f"`{item}`").alias("item"), *[(F.col(f"`{s}`").cast("double") + F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(scores)])
    return rows.groupBy("grp", "item").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(scores))])


def fuse(cands: DataFrame, n_scores: int, k: float = 60.0, weights: Sequence[float] | None = None) -> DataFrame:
    """(grp, item, rrf): the sum over the scores of weight / (k + rank)."""
    w: Mapping[int, float] = dict(enumerate(weights or [1.0] * n_scores))
    long = cands.select("grp", "item", F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"s{i}").alias("value")) for i in range(n_scores)])).alias("x")).select("grp", "item", "x.*")
    values = long.groupBy("grp", "score", "value").agg(F.count("*").alias("n"))
    ranks = exact_rank(values, ["grp", "score"], "value").drop("n")
    weight = F.element_at(F.array(*[F.lit(float(w[i])) for i in range(n_scores)]), F.col("score") + 1)
    ranked = long.join(ranks, ["grp", "score", "value"]).select("grp", "item", (weight / (F.lit(k) + F.col("rank"))).alias("part"), "score")
    # summed in the order of the scores: equal ranks give bit-equal sums
    per = ranked.groupBy("grp", "item").agg(*[F.max(F.when(F.col("score") == i, F.col("part"))).alias(f"p{i}") for i in range(n_scores)])
    total = F.lit(0.0)
    for i in range(n_scores):
        total = total + F.col(f"p{i}")
    return per.select("grp", "item", F.round(total, 12).alias("rrf"))


def ranking(features: DataFrame, scores: Sequence[str], group: str = "jd_id", item: str = "cv_id", k: float = 60.0, weights: Sequence[float] | None = None) -> DataFrame:
    """(grp, item, rrf, place): the whole fused ranking of every group; ties share a place."""
    fused = materialize(fuse(materialize(candidates(features, scores, group, item), "p7-cands"), len(scores), k, weights), "p7-fused")
    values = fused.groupBy("grp", "rrf").agg(F.count("*").alias("n"))
    places = exact_rank(values, ["grp"], "rrf").drop("n").withColumnRenamed("rank", "place")
    return fused.join(places, ["grp", "rrf"]).select("grp", "item", "rrf", "place")


SCORES = ("bm25_full_norm", "emb_cosine_norm", "vendor_cov")


def found(features: DataFrame, at_least: int = 10) -> DataFrame:
    """The candidate ranked first in each jd_id with at least ten countable candidates."""
    cands = materialize(candidates(features, SCORES), "p7-cands")
    sizes = cands.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).select("grp")
    fused = fuse(cands.join(sizes, "grp", "left_semi"), len(SCORES))
    best = top_n(fused, F.col("grp"), F.col("rrf"), F.col("item"), n=1)
    return best.select(F.col("group_key").alias("jd_id"), F.col("item_id").alias("cv_id"))
