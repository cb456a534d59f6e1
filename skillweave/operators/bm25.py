"""Group-wise Okapi BM25 as relational plans.

A pair table has a group, a row id and token arrays. The corpus of a group are its rows; the query is
the group's own. Only query terms are counted per row (a semi-join before the aggregation); document
frequencies and the mean idf use all terms. Everything is keyed: nothing is aligned by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25


def first_per_group(df: DataFrame, group: str, value: Column, order: Column, name: str) -> DataFrame:
    """(group, name): the value of the group's first row under ``order``."""
    return df.groupBy(group).agg(F.min_by(value, order).alias(name))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(grp, n_docs, avgdl, avg_idf) of (grp, row_id, toks)."""
    per_doc = docs.groupBy("grp").agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"))
    avg = _idf0(docs, per_doc).groupBy("grp").agg(F.avg("idf0").alias("avg_idf"))
    return per_doc.join(avg, "grp", "left")


def _idf0(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    df = docs.select("grp", F.explode(F.array_distinct("toks")).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("df"))
    idf0 = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return df.join(per_doc.select("grp", "n_docs"), "grp").select("grp", "term", "df", idf0.alias("idf0"))


def idf(docs: DataFrame) -> DataFrame:
    """(grp, term, df, idf): negative idf values are replaced by a quarter of the group's mean."""
    per_doc = docs.groupBy("grp").agg(F.count("*").alias("n_docs"))
    base = _idf0(docs, per_doc)
    mean = base.groupBy("grp").agg(F.avg("idf0").alias("avg_idf"))
    return base.join(mean, "grp").select("grp", "term", "df", F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(EPSILON * F.col("avg_idf")).alias("idf"))


def score(docs: DataFrame, query: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(grp, row_id, score) for every row of ``docs`` (grp, row_id, toks); 0 without a shared term.

    ``query`` has (grp, term, qtf), each term once with its weight.
    """
    query = query.filter("term IS NOT NULL")
    sizes = docs.groupBy("grp").agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"))
    terms = docs.select("grp", "row_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    tf = terms.join(query.select("grp", "term"), ["grp", "term"], "left_semi").groupBy("grp", "row_id", "dl", "term").agg(F.count("*").alias("tf"))
    hit = tf.join(query, ["grp", "term"]).join(idf(docs).select("grp", "term", "idf"), ["grp", "term"]).join(sizes.select("grp", "avgdl"), "grp")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    total = hit.groupBy("grp", "row_id").agg(F.sum(part).alias("score"))
    return docs.select("grp", "row_id").join(total, ["grp", "row_id"], "left").select("grp", "row_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(grp, term, qtf) of (grp, toks): repeats count."""
    return queries.select("grp", F.explode("toks").alias("term")).groupBy("grp", "term").agg(F.count("*").alias("qtf"))


def weighted(query: DataFrame, weights: DataFrame) -> DataFrame:
    """Query terms repeated max(1, round(weight)) times, rounding half to even; (grp, term, weight), unlisted 1."""
    w = query.join(weights, ["grp", "term"], "left")
    return w.select("grp", "term", (F.col("qtf") * F.greatest(F.lit(1.0), F.bround(F.coalesce("weight", F.lit(1.0)), 0))).alias("qtf"))


def combine(full: Column, skills: Column, w_full: float = 0.5, w_skills: float = 0.5) -> Column:
    total = (w_full + w_skills) or 1.0
    return (w_full * full + w_skills * skills) / total
