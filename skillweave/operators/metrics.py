"""Ranking, correlation and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def ndcg(df: DataFrame, group: str, score: str, label: str, item: str, k: int, gain: str = "exp") -> DataFrame:
    """(group, n, ndcg) of groups with at least two rows. Labels count by their dense order in the group;
    ties in the score are broken by the smaller item."""
    g = Window.partitionBy(group)
    d = df.withColumn("n_", F.count("*").over(g)).filter("n_ >= 2").withColumn("ord_", F.dense_rank().over(g.orderBy(F.col(label))) - 1)
    val = (F.pow(F.lit(2.0), F.col("ord_")) - 1) if gain == "exp" else F.col("ord_").cast("double")
    d = d.withColumn("gain_", val).withColumn("pos_", F.row_number().over(g.orderBy(F.col(score).desc(), F.col(item).asc()))).withColumn("best_", F.row_number().over(g.orderBy(F.col("ord_").desc(), F.col(item).asc())))
    disc = lambda p: 1 / F.log2(F.col(p) + 1.0)
    at = lambda p: F.sum(F.when(F.col(p) <= k, F.col("gain_") * disc(p)).otherwise(0.0))
    return d.groupBy(group).agg(F.count("*").alias("n"), (at("pos_") / (at("best_") + TINY)).alias("ndcg"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> Column:
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    return F.sum(F.when(ok, F.col(value) * F.col(weight))) / (F.sum(F.when(ok, F.col(weight))) + TINY)


def average_rank(group: str | None, x: str) -> Column:
    """Ranks with ties averaged, ascending."""
    keys = [group] if group else []
    below = F.rank().over(Window.partitionBy(*keys).orderBy(x))
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return below + (ties - 1) / 2.0


def correlations(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, pearson, spearman); null where one side is constant."""
    r = df.withColumn("rx_", average_rank(group, x)).withColumn("ry_", average_rank(group, y))

    def corr(a: str, b: str) -> Column:
        flat = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
        return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))

    return r.groupBy(group).agg(F.count("*").alias("n"), corr(x, y).alias("pearson"), corr("rx_", "ry_").alias("spearman"))


def _by_score(df: DataFrame, score: str, positive: Column, group: str | None) -> DataFrame:
    """(g, score, p, n): positives and all rows of each distinct score; ties are one step."""
    g = F.col(group) if group else F.lit(0)
    return df.groupBy(g.alias("g_"), F.col(score).alias("s_")).agg(F.sum(positive.cast("long")).alias("p_"), F.count("*").alias("n_"))


def auc(df: DataFrame, score: str, positive: Column, group: str | None = None) -> DataFrame:
    """(g_, roc_auc, average_precision); null with a single class. Works on distinct scores, after a
    combining aggregation."""
    t = _by_score(df, score, positive, group)
    up = Window.partitionBy("g_").orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("g_").orderBy(F.col("s_").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("neg_", F.col("n_") - F.col("p_")).withColumn("below_", F.coalesce(F.sum("neg_").over(up), F.lit(0)))
    t = t.withColumn("cp_", F.sum("p_").over(down)).withColumn("cn_", F.sum("n_").over(down))
    pos, neg = F.sum("p_"), F.sum("neg_")
    wins = F.sum(F.col("p_") * (F.col("below_") + F.col("neg_") / 2.0))
    ap = F.sum(F.col("p_") * F.col("cp_") / F.col("cn_")) / pos
    both = (pos > 0) & (neg > 0)
    return t.groupBy("g_").agg(F.when(both, wins / (pos * neg)).alias("roc_auc"), F.when(both, ap).alias("average_precision"))


def recall_mrr(ranked: DataFrame, group: str, pos: str, relevant: Column, k: int) -> DataFrame:
    """(group, recall, mrr) at k of groups with a relevant row; ``pos`` counts from 1."""
    rel = relevant.cast("int")
    hit = F.when(relevant & (F.col(pos) <= k), F.col(pos))
    t = ranked.groupBy(group).agg(F.sum(rel).alias("p_"), F.count(hit).alias("h_"), F.min(hit).alias("first_"))
    return t.filter("p_ > 0").select(group, (F.col("h_") / F.col("p_")).alias("recall"), F.coalesce(1 / F.col("first_"), F.lit(0.0)).alias("mrr"))


def micro_prf(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) over two sets of keys; 0 where undefined."""
    g, f = gold.select(*keys).distinct().withColumn("g_", F.lit(1)), found.select(*keys).distinct().withColumn("f_", F.lit(1))
    j = g.join(f, keys, "full")
    c = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    t = j.agg(c(F.col("g_").isNotNull() & F.col("f_").isNotNull()).alias("tp"), c(F.col("g_").isNull()).alias("fp"), c(F.col("f_").isNull()).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)
