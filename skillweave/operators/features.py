"""Feature assembly of a pair table, and the embedding feature."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import norm_text, tokens
from skillweave.functions.vectors import dot
from skillweave.operators import bm25, norm, skills
from skillweave.runtime import materialize, spread
from skillweave.schema import FeatureConfig, require_columns


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedEmbedder:
    """Deterministic unit vectors from hashed words and letter trigrams; a stand-in for a trained encoder."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashed-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out, known = np.zeros((len(texts), self.dim)), {}
        for r, t in enumerate(texts):
            for w in t.split():
                if (v := known.get(w)) is None:
                    if len(known) >= 5000:  # bounds the memory
                        known.clear()
                    v = known[w] = np.zeros(self.dim)
                    for g in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                        h = zlib.crc32(g.encode())
                        v[h % self.dim] += 1 if h >> 16 & 1 else -1
                out[r] += v
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(texts: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> DataFrame:
    """(key, vec) of each distinct normalised text of the column ``text``; known keys come from the cache."""
    t = texts.select(norm_text("text").alias("text")).distinct().select(F.sha1(F.concat(F.lit(embedder.name + "|"), "text")).alias("key"), "text")
    todo = t if cache is None else t.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vec": list(embedder.encode(list(pdf["text"])))})

    new = todo.mapInPandas(run, "key string, vec array<double>")
    return new if cache is None else new.unionByName(t.select("key").join(cache, "key").select("key", "vec"))


def text_key(embedder: Embedder, col: str):
    return F.sha1(F.concat(F.lit(embedder.name + "|"), norm_text(col)))


def cosine_feature(pairs: DataFrame, embedder: Embedder, per_group: bool = True, cache: DataFrame | None = None) -> DataFrame:
    """(row_id, emb_cosine, emb_cosine_norm): each distinct text is embedded once."""
    texts = pairs.select(F.col("job_description_text").alias("text")).unionByName(pairs.select(F.col("resume_text").alias("text")))
    vecs = materialize(embed(texts, embedder, cache), "vectors")
    p = pairs.select("row_id", "grp", text_key(embedder, "job_description_text").alias("jk"), text_key(embedder, "resume_text").alias("ck"))
    p = p.join(vecs.withColumnsRenamed({"key": "jk", "vec": "jv"}), "jk").join(vecs.withColumnsRenamed({"key": "ck", "vec": "cv"}), "ck")
    p = p.select("row_id", "grp", dot("jv", "cv").alias("emb_cosine"))
    return norm.minmax_plain(p, "grp", "emb_cosine", "emb_cosine_norm") if per_group else p.withColumn("emb_cosine_norm", F.col("emb_cosine"))


def keyed_pairs(pairs: DataFrame, group=None) -> DataFrame:
    """The pair table with ``grp``; rows without a group are left out."""
    require_columns(pairs, ["row_id", "jd_id", "job_description_text", "resume_text"])
    g = F.lower(F.trim("jd_id")) if group is None else group
    return spread(pairs).withColumn("grp", g).filter("grp IS NOT NULL")


def build(pairs: DataFrame, aliases: DataFrame, cfg: FeatureConfig = FeatureConfig(), embedder: Embedder | None = None) -> DataFrame:
    """(row_id, grp, vendor_cov, skill_score, bm25_full_norm, bm25_skills_norm, bm25_combo, final_score[,
    emb_cosine, emb_cosine_norm]) of each row with a group. The JD of a group is its first row's."""
    p = materialize(keyed_pairs(pairs).select("row_id", "grp", "job_description_text", "resume_text"), "pairs")
    toks = materialize(p.select("grp", "row_id", tokens("resume_text").alias("toks")), "toks")
    jd = bm25.first_per_group(p, "grp", F.col("job_description_text"), F.col("row_id"), "jd_text")
    full = bm25.score(toks, bm25.query_terms(jd.select("grp", tokens("jd_text").alias("toks"))))
    cv_sk = skills.extract(p.select(F.col("row_id").alias("doc_id"), F.col("resume_text")).select("doc_id", skills.clean_text("resume_text").alias("text")), aliases)
    cv_sk = materialize(cv_sk.withColumnRenamed("doc_id", "row_id"), "cv-skills")
    jd_sk = skills.extract(jd.select(F.col("grp").alias("doc_id"), skills.clean_text("jd_text").alias("text")), aliases).withColumnsRenamed({"doc_id": "grp", "skills": "wanted"})
    sets = p.select("row_id", "grp").join(cv_sk, "row_id").join(jd_sk, "grp")
    sk = bm25.score(sets.select("grp", "row_id", F.col("skills").alias("toks")), bm25.query_terms(jd_sk.select("grp", F.col("wanted").alias("toks"))))
    cov = skills.coverage(F.col("skills"), F.col("wanted"), cfg.laplace_a, cfg.laplace_b)
    n1 = norm.minmax(full, "grp", "score", "bm25_full_norm").select("row_id", "bm25_full_norm")
    n2 = norm.minmax(sk, "grp", "score", "bm25_skills_norm").select("row_id", "bm25_skills_norm")
    f = sets.select("row_id", "grp", cov.alias("vendor_cov")).join(n1, "row_id").join(n2, "row_id")
    f = f.withColumn("skill_score", F.col("vendor_cov")).withColumn("bm25_combo", bm25.combine(F.col("bm25_full_norm"), F.col("bm25_skills_norm"), cfg.bm25_full_weight, cfg.bm25_skills_weight))
    f = f.withColumn("final_score", bm25.combine(F.col("skill_score"), F.col("bm25_combo"), cfg.final_skill_weight, cfg.final_bm25_weight))
    if embedder is not None and cfg.use_embedding:
        f = f.join(cosine_feature(p, embedder, cfg.emb_per_jd_norm).drop("grp"), "row_id")
    return f
