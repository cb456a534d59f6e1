"""Row-oriented operations on entity tables: active rows, latest states, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.runtime import broadcast_if_small


def active(df: DataFrame, id_col: str, text_col: str, flag: str = "is_active", owner: Column | None = None) -> DataFrame:
    """(id, text) of active rows with a text; both conditions reach the scan."""
    cond = F.col(flag) & F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != "")
    return df.filter(cond if owner is None else cond & owner).select(id_col, text_col)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns: an aggregation with map-side combining, no sort."""
    return df.groupBy(F.col(key).alias("k_")).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("row_")).select("row_.*")


def applicants(links: DataFrame, cvs: DataFrame, jd: str | None = None) -> DataFrame:
    """Links (jd_id, cv_id) joined with the CVs, of one JD or of all."""
    sel = links if jd is None else links.filter(F.col("jd_id") == jd)
    return sel.join(cvs, "cv_id")


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys don't exist yet, each once."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def sample_links(left: DataFrame, right: DataFrame, lkey: str, rkey: str, k: int) -> DataFrame:
    """k pseudo-random partners per left row, without a cross join: for each draw the left row's hash lands
    on a slot of the numbered right rows."""
    from skillweave.functions.ids import draw, rank_globally

    r = rank_globally(right.select(F.col(rkey).alias("r_")).distinct(), [F.col("r_")], "slot")
    n = r.agg(F.count("*").alias("n_"))
    draws = left.select(F.col(lkey).alias("l_")).distinct().join(F.broadcast(n)).withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n_").cast("int")) - 1)))
    start = F.pmod(draw(F.lit("42"), F.col("l_").cast("string")), F.col("n_"))
    step = F.greatest(F.floor(F.col("n_") / F.greatest(F.lit(k), F.lit(1))), F.lit(1))
    s = draws.withColumn("slot", F.pmod(start + F.col("j") * step, F.col("n_")).cast("long"))
    return s.join(broadcast_if_small(r), "slot").select(F.col("l_").alias(lkey), F.col("r_").alias(rkey))


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the text rules, for users of SQL."""
    from skillweave.functions import text

    spark.udf.register("stem_tokens", text.stem)
    spark.udf.register("char_similarity", text.char_similarity)
    spark.udf.register("unescape_html", text._clean_html)


def candidate_sql(spark: SparkSession, views: dict[str, DataFrame], sql: str) -> DataFrame:
    """A configurable candidate query over registered views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
