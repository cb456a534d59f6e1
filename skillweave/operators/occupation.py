"""Occupation scoring and skill packs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.functions.text import plain_tokens, ratio
from skillweave.runtime import broadcast_if_small


def simple_topk(queries: DataFrame, occupations: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, occ_id, score, place): 0.6 * letter similarity of label and query + 0.4 * Jaccard of tokens.

    The occupations are a dictionary, read in blocks of bounded size; queries stay where they are and keep
    ``k`` entries per block, so that only those are shuffled."""
    spark = queries.sparkSession
    q = queries.select("query_id", plain_tokens("text").alias("toks"))
    o = occupations.select("occ_id", F.lower("label").alias("label"), F.array_distinct(plain_tokens(F.concat_ws(" ", "label", "text"))).alias("toks"))
    schema = T.StructType([queries.schema["query_id"], occupations.schema["occ_id"], T.StructField("score", T.DoubleType())])
    out, rows = spark.createDataFrame([], schema), []

    def scan(entries: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(entries)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            occ = [(i, lab, set(t)) for i, lab, t in shared.value]
            for pdf in batches:
                hits = []
                for qid, toks in zip(pdf["query_id"], pdf["toks"]):
                    words, joined = set(toks), " ".join(toks)
                    s = [(0.6 * ratio(lab, joined) + 0.4 * len(words & t) / max(len(words | t), 1), i) for i, lab, t in occ]
                    hits += [(qid, i, x) for x, i in sorted(s, key=lambda y: (-round(y[0], 9), y[1]))[:k]]
                yield pd.DataFrame(hits, columns=["query_id", "occ_id", "score"])

        return q.mapInPandas(run, schema)

    for r in o.toLocalIterator():
        rows.append((r["occ_id"], r["label"], list(r["toks"])))
        if len(rows) == block:
            out, rows = out.unionByName(scan(rows)), []
    return _best(out.unionByName(scan(rows)) if rows else out, "query_id", "occ_id", k)


def _best(scored: DataFrame, q: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(q).orderBy(F.round("score", 9).desc(), item)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def tfidf(docs: DataFrame, toks: Column, max_df: float = 0.8) -> DataFrame:
    """(doc_id, term, w): smooth idf ln((1 + n) / (1 + df)) + 1, term counts, unit length; terms in over
    ``max_df`` of the documents are left out."""
    tf = docs.select("doc_id", F.explode(toks).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.countDistinct("doc_id").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).filter(F.col("df") <= max_df * F.col("n"))
    w = tf.join(df, "term").select("doc_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(length, "doc_id").select("doc_id", "term", (F.col("w") / F.col("len")).alias("w"))


def tfidf_topk(corpus: DataFrame, queries: DataFrame, toks, k: int = 5, max_df: float = 0.8) -> DataFrame:
    """(query_id, doc_id, score, place): the corpus documents (doc_id, text) closest to each query
    (query_id, text) by the corpus's own TF-IDF weights; only documents sharing a term are scored."""
    n = corpus.agg(F.countDistinct("doc_id").alias("n"))
    docs = tfidf(corpus, toks(F.col("text")), max_df)
    df = corpus.select("doc_id", F.explode(F.array_distinct(toks(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).filter(F.col("df") <= max_df * F.col("n"))
    q = queries.select("query_id", F.explode(toks(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    q = q.join(df, "term").select("query_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("v"))
    ql = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    q = q.join(ql, "query_id").select("query_id", "term", (F.col("v") / F.col("len")).alias("v"))
    s = docs.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    return _best(s, "query_id", "doc_id", k)


def pack_buckets(packs: DataFrame, slugs: DataFrame) -> DataFrame:
    """(canonical, bucket): essential and optional skills over the given slugs; essential wins."""
    p = packs.join(broadcast_if_small(slugs.select("slug").distinct()), "slug")
    return p.groupBy("canonical").agg(F.min(F.when(F.col("bucket") == "essential", 0).otherwise(1)).alias("b")).select("canonical", F.when(F.col("b") == 0, "essential").otherwise("optional").alias("bucket"))


def pack_dictionary(packs: DataFrame, slugs: DataFrame, include: str = "both") -> DataFrame:
    """(canonical, aliases) of the packs of the slugs; raises KeyError for a slug without a pack."""
    wanted = slugs.select("slug").distinct()
    lost = wanted.join(packs.select("slug").distinct(), "slug", "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"no pack for {lost[0]['slug']!r}")
    p = packs.join(broadcast_if_small(wanted), "slug")
    if include != "both":
        p = p.filter(F.col("bucket") == include)
    e = p.select("canonical", "slug", F.posexplode_outer("aliases").alias("pos", "alias")).filter("alias IS NOT NULL")
    first = e.groupBy("canonical", F.lower("alias").alias("k")).agg(F.min(F.struct("slug", "pos", "alias")).alias("s"))
    lists = first.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["alias"]).alias("aliases"))
    return p.select("canonical").distinct().join(lists, "canonical", "left").select("canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
