"""The engine's surface: rank, search, annotate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions.ids import stable_id
from skillweave.functions.text import merge_jd
from skillweave.operators import features, ranker, spans
from skillweave.operators.features import Embedder, HashedEmbedder
from skillweave.runtime import materialize
from skillweave.schema import FeatureConfig, require_columns
from skillweave.sources.index_store import IndexStore


class Engine:
    """Batch counterparts of the service's endpoints. The dictionary, the embedder and the model are inputs."""

    def __init__(self, spark: SparkSession, aliases: DataFrame, model: ranker.LambdaMart | None = None, embedder: Embedder | None = None, cfg: FeatureConfig = FeatureConfig()):
        self.spark, self.aliases, self.model, self.embedder, self.cfg = spark, aliases, model, embedder or HashedEmbedder(), cfg

    @property
    def loaded(self) -> bool:
        return self.model is not None

    def reload(self, path: str) -> None:
        self.model = ranker.LambdaMart.load(path)

    def rank(self, requests: DataFrame, candidates: DataFrame, topk: int | None = None) -> DataFrame:
        """(jd_id, cv_id, pred, score, place) per request.

        ``requests`` has (jd_id?, job_requirement, job_description), ``candidates`` (jd_id, cv_id?, resume_text).
        A request without texts or candidates has no rows; missing ids are made from the texts. Without
        a model the final score ranks.
        """
        require_columns(requests, ["jd_id", "job_requirement", "job_description"])
        require_columns(candidates, ["jd_id", "cv_id", "resume_text"])
        text = merge_jd("job_requirement", "job_description")
        r = requests.select(F.coalesce("jd_id", stable_id(text, "jd")).alias("jd_id"), text.alias("job_description_text")).filter("job_description_text <> ''")
        c = candidates.select("jd_id", F.coalesce("cv_id", stable_id("resume_text", "cv")).alias("cv_id"), "resume_text")
        # a candidate counts once per request, with the smallest of its texts; so does a request that comes twice
        r = r.groupBy("jd_id").agg(F.min("job_description_text").alias("job_description_text"))
        c = c.filter("jd_id IS NOT NULL").groupBy("jd_id", "cv_id").agg(F.min("resume_text").alias("resume_text"))
        p = materialize(c.join(r, "jd_id").withColumn("row_id", F.sha2(F.concat_ws("\u0001", "jd_id", "cv_id"), 256)), "rank-pairs")
        f = features.build(p, self.aliases, self.cfg, self.embedder)
        scored = self.model.predict(f) if self.model else f.withColumn("pred", F.col("final_score"))
        s = scored.select("row_id", "pred").join(p.select("row_id", "jd_id", "cv_id"), "row_id")
        best = ranker.rank(s, "jd_id", "pred", "cv_id", topk)
        return best.select("jd_id", "cv_id", "pred", F.col("pred").alias("score"), "place")

    def search(self, store: IndexStore, queries: DataFrame, topk: int = 10, approximate: bool = False) -> DataFrame:
        """The nearest items of each (query_id, text); blank queries have none; a missing index is an error."""
        if not store.exists():
            raise FileNotFoundError(f"no index at {store.path}")
        q = queries.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
        vecs = features.embed(q.select("text"), self.embedder)
        q = q.withColumn("key", features.text_key(self.embedder, "text")).join(vecs, "key").select("query_id", "vec")
        return store.search(q, topk, approximate)

    def annotate(self, docs: DataFrame, patterns: DataFrame, skills: DataFrame, relax: float = 0.2, overlaps: bool = False) -> DataFrame:
        """(doc_id, text, results, unique_skills) with all tiers and the token scanner."""
        high = spans.dictionary_rows(patterns.filter("source = 'high'").select("skill_id", "form"))
        hits = spans.scan(docs, patterns, [(r["skill_id"], r["form"].lower().split(" ")) for r in high], relax, None if overlaps else "source")
        return spans.annotation(docs, hits, skills)
