"""Vector search: exact by blocks of queries, approximate by inverted lists; centroids and nearest entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions.vectors import dot, l2_normalize, squared_l2

BLOCK = 4096


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """The stated query set, streamed in blocks of bounded size."""
    ids, vecs = [], []
    for r in queries.toLocalIterator():
        ids.append(r["query_id"])
        vecs.append(r["vec"])
        if len(ids) == block:
            yield ids, np.array(vecs, dtype=np.float64)
            ids, vecs = [], []
    if ids:
        yield ids, np.array(vecs, dtype=np.float64)


def exact_topk(base: DataFrame, queries: DataFrame, k: int, metric: str = "ip", block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, score, place) of the k best rows of ``base`` (item_id, vec) per query (query_id, vec).

    'ip' ranks by inner product, 'l2' by squared distance, ties by the smaller item. Each block of
    queries meets all rows in one matrix product per batch; a partition keeps k rows per query, so only
    k rows per query and partition are shuffled. Null vectors are left out.
    """
    spark = base.sparkSession
    rows = base.filter("item_id IS NOT NULL AND vec IS NOT NULL").select("item_id", "vec")
    out = spark.createDataFrame([], "query_id bigint, item_id bigint, score double")
    for ids, mat in _query_blocks(queries.filter("query_id IS NOT NULL AND vec IS NOT NULL"), block):
        shared = spark.sparkContext.broadcast((np.array(ids), mat))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            keep_s = np.full((len(qid), 0), 0.0)
            keep_i = np.zeros((len(qid), 0), dtype=np.int64)
            for pdf in batches:
                if not len(pdf):
                    continue
                v = np.array(pdf["vec"].tolist(), dtype=np.float64)
                s = q @ v.T
                if metric == "l2":
                    s = -((q * q).sum(1)[:, None] - 2 * s + (v * v).sum(1)[None, :])
                s = np.concatenate([keep_s, s], 1)
                i = np.concatenate([keep_i, np.broadcast_to(pdf["item_id"].to_numpy(), (len(qid), len(v)))], 1)
                order = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
                keep_s, keep_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            n = keep_s.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(qid, n), "item_id": keep_i.ravel(), "score": keep_s.ravel()})

        part = rows.mapInPandas(run, "query_id bigint, item_id bigint, score double")
        out = out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "item_id")
    best = out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return best.withColumn("score", -F.col("score")) if metric == "l2" else best


def fit_lists(sample: np.ndarray, lists: int = 64, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Unit centroids by spherical k-means over a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    k = min(lists, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)] if k else np.zeros((0, 0))
    for _ in range(rounds if k else 0):
        a = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, a, sample)
        c = np.where((np.bincount(a, minlength=k) > 0)[:, None], sums, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def to_lists(df: DataFrame, key: str, centroids: np.ndarray, n: int) -> DataFrame:
    """(key, vec, list): each vector once per one of its ``n`` nearest lists."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.array(pdf["vec"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            near = np.argsort(-(v @ centroids.T), axis=1)[:, :n] if len(pdf) else []
            yield pdf.assign(lists=[list(map(int, r)) for r in near])

    t = df.select(key, "vec").mapInPandas(run, f"{key} bigint, vec array<double>, lists array<int>")
    return t.select(key, "vec", F.explode("lists").alias("list"))


def ivf_topk(base: DataFrame, queries: DataFrame, k: int, lists: int = 64, spill: int = 2, probe: float = 0.4, max_fit: int = 50_000) -> DataFrame:
    """Approximate top-k by inner product of unit vectors through inverted lists.

    The lists are fitted on at most ``max_fit`` rows; every row is then filed under its ``spill`` nearest
    lists, a query looks into the nearest share ``probe`` of them, and candidates are ranked by their exact
    product. Lists have no cap. The more clustered the vectors, the smaller a probe will do; the default
    reaches a recall of 0.9 even on vectors without clusters.
    """
    unit = lambda d, key: d.filter(f"{key} IS NOT NULL AND vec IS NOT NULL").select(key, l2_normalize("vec").alias("vec"))
    b, q = unit(base, "item_id"), unit(queries, "query_id")
    n = b.count()
    fit = b if n <= max_fit else b.filter(F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)) < (1 << 20) * max_fit // n)
    rows = fit.select("vec").orderBy(F.xxhash64("vec")).limit(max_fit).collect()
    c = fit_lists(np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), -1), lists)
    if not len(c):
        return base.sparkSession.createDataFrame([], "query_id bigint, item_id bigint, score double, place int")
    bl, ql = to_lists(b, "item_id", c, spill), to_lists(q, "query_id", c, max(1, round(len(c) * probe)))
    hit = bl.join(ql.select("query_id", "list", F.col("vec").alias("qv")), "list")
    scored = hit.select("query_id", "item_id", dot("vec", "qv").alias("score")).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    best = [F.round("score", 9).desc(), F.col("item_id").asc()]
    part = scored.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(16)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*best))).filter(F.col("r") <= k).drop("r", "salt")
    return part.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("place") <= k)


def centroid(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, vec): the mean of each group's vectors, component by component (not renormalised)."""
    e = df.filter(F.col(vec).isNotNull()).select(group, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(group, "i").agg(F.avg("x").alias("m"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vec))  # as long as a vector


def nearest(items: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, entry_id, score): the entry (entry_id, vec) with the highest cosine of each unit vector
    (query_id, vec), if it reaches the threshold. Entries are a dictionary, read in blocks."""
    return exact_by_entries(items, entries, 1).filter(F.col("score") >= threshold).drop("place")


def exact_by_entries(items: DataFrame, entries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, entry_id, score, place): the k best entries of every item; items may be many, no shuffle of them."""
    spark = items.sparkSession
    src = items.filter("query_id IS NOT NULL AND vec IS NOT NULL").select("query_id", "vec")
    out = spark.createDataFrame([], "query_id bigint, entry_id bigint, score double")
    for ids, mat in _query_blocks(entries.select(F.col("entry_id").alias("query_id"), "vec"), block):
        shared = spark.sparkContext.broadcast((np.array(ids), mat))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            eid, e = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.array(pdf["vec"].tolist(), dtype=np.float64) @ e.T
                order = np.lexsort((np.broadcast_to(eid, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                n = order.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "entry_id": eid[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

        out = out.unionByName(src.mapInPandas(run, "query_id bigint, entry_id bigint, score double"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "entry_id")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


__all__ = ["centroid", "exact_by_entries", "exact_topk", "ivf_topk", "nearest", "squared_l2"]
