"""The vector index as partitioned Parquet: build, load, append, search, and the embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skillweave.functions.vectors import l2_normalize
from skillweave.operators.knn import exact_topk, ivf_topk
from skillweave.schema import require_columns

BUCKETS = 16


class IndexStore:
    """Rows (item_id, vec, updated_at, is_active). Updates append; readers take the latest row of each id and
    leave out inactive ones, so that an id has one vector and deletions hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/vectors").schema
            return True
        except AnalysisException:
            return False

    def _prepare(self, df: DataFrame) -> DataFrame:
        require_columns(df, ["item_id", "vec"])
        df = df.withColumn("updated_at", F.col("updated_at") if "updated_at" in df.columns else F.current_timestamp()).withColumn("is_active", F.col("is_active") if "is_active" in df.columns else F.lit(True))
        return df.select(F.col("item_id").cast("long").alias("item_id"), l2_normalize("vec", additive=True).alias("vec"), "updated_at", "is_active", F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).alias("bucket"))

    def build(self, df: DataFrame, kind: str = "flat") -> None:
        """Writes the index and its description; an empty input is an error."""
        p = self._prepare(df)
        if p.isEmpty():
            raise ValueError("no vectors to index")
        # checked before anything is overwritten: a bad input leaves the index as it was
        meta = p.filter("vec IS NOT NULL").agg(F.max(F.size("vec")).alias("dim"), F.min(F.size("vec")).alias("low")).first()
        if meta["dim"] != meta["low"]:
            raise ValueError("vectors of different lengths")
        p.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/vectors")
        count = self.load().count()
        self.spark.createDataFrame([(meta["dim"], count, "ip", kind)], "dim int, count bigint, metric string, index_kind string").withColumn("created_at", F.current_timestamp()).write.mode("overwrite").json(f"{self.path}/meta")

    def append(self, df: DataFrame) -> None:
        self._prepare(df).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/vectors")

    def load(self) -> DataFrame:
        raw = self.spark.read.parquet(f"{self.path}/vectors")
        # a missing time counts as the oldest; of equal times a deletion, then the larger vector, is taken
        order = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")), ~F.coalesce("is_active", F.lit(True)), "vec")
        last = raw.groupBy("item_id").agg(F.max_by(F.struct("vec", F.coalesce("is_active", F.lit(True)).alias("is_active")), order).alias("s"), F.max("updated_at").alias("updated_at"))
        return last.select("item_id", "s.vec", "updated_at", "s.is_active").filter("is_active")

    def meta(self) -> DataFrame:
        """The description with the current count."""
        now = self.load().agg(F.count("*").alias("current"))
        return self.spark.read.json(f"{self.path}/meta").join(F.broadcast(now)).withColumn("count", F.col("current")).drop("current")

    def search(self, queries: DataFrame, k: int = 10, approximate: bool = False) -> DataFrame:
        q = queries.select("query_id", l2_normalize("vec", additive=True).alias("vec"))
        if not approximate:
            return exact_topk(self.load(), q, k)
        return ivf_topk(self.load(), q, k)


class VectorCache:
    """(key, vec) rows that grow by the keys not yet there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def put(self, df: DataFrame) -> None:
        old = self.get()
        new = df.select("key", "vec").dropDuplicates(["key"])
        (new if old is None else new.join(old.select("key"), "key", "left_anti")).write.mode("append").parquet(self.path)
