"""Building and maintaining the skill reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import abbreviation, clean_label, looks_vietnamese, stem, strip_accents, sub_forms
from skillweave.runtime import broadcast_if_small

RELAX = 0.2


def processed(raw: DataFrame, lemma=None) -> DataFrame:
    """(skill_id, skill_name, skill_cleaned, skill_type, skill_lemmed, skill_stemmed, skill_len, abbreviation,
    unique_token, match_on_stemmed) of (skill_id, skill_name, skill_type)."""
    c = raw.withColumn("skill_cleaned", clean_label("skill_name"))
    c = c.withColumn("skill_lemmed", lemma(F.col("skill_cleaned")) if lemma else F.col("skill_cleaned")).withColumn("skill_stemmed", stem("skill_cleaned"))
    c = c.withColumn("skill_len", F.when(F.col("skill_cleaned") == "", 0).otherwise(F.size(F.split("skill_cleaned", " ")))).withColumn("abbreviation", abbreviation("skill_name"))
    u = unique_tokens(c.select("skill_id", "skill_cleaned"))
    return c.join(u, "skill_id", "left").withColumn("unique_token", F.coalesce("unique_token", F.lit(""))).withColumn("match_on_stemmed", F.col("skill_len") == 1)


def token_counts(skills: DataFrame, col: str) -> DataFrame:
    return skills.select(F.explode(F.split(col, " ")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def unique_tokens(skills: DataFrame) -> DataFrame:
    """(skill_id, unique_token): the first token of a name that occurs nowhere else."""
    e = skills.select("skill_id", F.posexplode(F.split("skill_cleaned", " ")).alias("pos", "token")).filter("token <> ''")
    once = token_counts(skills, "skill_cleaned").filter("n = 1")
    return e.join(broadcast_if_small(once), "token").groupBy("skill_id").agg(F.min_by("token", "pos").alias("unique_token"))


def surface_forms(skills: DataFrame) -> DataFrame:
    """(skill_id, skill_name, skill_type, skill_len, high, low, match_on_tokens) by the length of the name.

    One word: the cleaned name, and its stem if it may match on stems. Two words: the lemma form; the
    stems in both orders; the last stem if it is rare enough, the first if it is much rarer than the last,
    both only if no other skill has them. More words: the lemma form, matched on tokens; acronyms of the
    name that no other name has.
    """
    multi = token_counts(skills.filter("skill_len > 1"), "skill_stemmed").withColumnRenamed("n", "cnt")
    s = skills.withColumn("st", F.split("skill_stemmed", " ")).withColumn("a", F.col("st")[0]).withColumn("z", F.element_at("st", -1))
    s = s.join(multi.withColumnsRenamed({"token": "a", "cnt": "na"}), "a", "left").join(multi.withColumnsRenamed({"token": "z", "cnt": "nz"}), "z", "left")
    na, nz = F.coalesce("na", F.lit(0)), F.coalesce("nz", F.lit(0))
    keep = lambda cond, v: F.when(cond, F.array(v)).otherwise(F.array().cast("array<string>"))
    two = F.col("skill_len") == 2
    s = s.withColumn("uni", F.concat(keep(two & (nz == 1), F.col("z")), keep(two & (nz > 0) & (na / F.greatest(nz, F.lit(1)) < RELAX), F.col("a"))))
    only = s.select(F.explode("uni").alias("u")).groupBy("u").agg(F.count("*").alias("n")).filter("n = 1")
    kept = s.select("skill_id", F.posexplode("uni").alias("p", "u")).join(broadcast_if_small(only), "u").groupBy("skill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "u"))), lambda x: x["u"]).alias("unis"))
    acr = s.filter("skill_len > 1").select("skill_id", "skill_len", F.explode(sub_forms("skill_name")).alias("acr"))
    sole = acr.groupBy("acr").agg(F.count("*").alias("n")).filter("n = 1")
    acr = acr.filter("skill_len > 2").join(broadcast_if_small(sole), "acr").groupBy("skill_id").agg(F.array_sort(F.collect_list("acr")).alias("acrs"))
    s = s.join(kept, "skill_id", "left").join(acr, "skill_id", "left")
    none = F.array().cast("array<string>")
    low = (
        F.when((F.col("skill_len") == 1) & F.col("match_on_stemmed"), F.array("skill_stemmed"))
        .when(two, F.concat(F.array("skill_stemmed", F.concat_ws(" ", "z", "a")), F.coalesce("unis", none))).when(F.col("skill_len") > 2, F.coalesce("acrs", none)).otherwise(none)
    )
    high = F.when(F.col("skill_len") == 1, F.col("skill_cleaned")).when(F.col("skill_len") > 1, F.col("skill_lemmed"))
    return s.select("skill_id", "skill_name", "skill_type", "skill_len", high.alias("high"), low.alias("low"), (F.col("skill_len") > 2).alias("match_on_tokens"))


def match_patterns(forms: DataFrame, short_ok: tuple[str, ...] = ("SQL", "NLP", "AI", "ML")) -> DataFrame:
    """(skill_id, source, form, case_sensitive): high forms, low forms, and acronym-looking low forms, which
    only match in their own case."""
    high = forms.filter("high IS NOT NULL AND high <> ''").select("skill_id", F.lit("high").alias("source"), F.col("high").alias("form"), F.lit(False).alias("case_sensitive"))
    low = forms.select("skill_id", F.explode("low").alias("form")).filter("form <> ''")
    up = F.col("form").rlike(r"^[A-Z&.]{2,}$") & ((F.length("form") > 2) | F.col("form").isin(*short_ok))
    return high.unionByName(low.select("skill_id", F.when(up, "acronym").otherwise("low").alias("source"), "form", up.alias("case_sensitive"))).distinct()


def accept_aliases(suggestions: DataFrame, threshold: float = 0.9, min_freq: int = 3, autowrite: bool = True) -> DataFrame:
    """The change log (alias, skill_id, similarity, freq, language, plain, action) of frequent, close phrases."""
    s = suggestions.filter((F.col("freq") >= min_freq) & (F.length("alias") > 2) & (F.col("similarity") >= threshold))
    return s.select("alias", "skill_id", F.round("similarity", 4).alias("similarity"), "freq", F.when(looks_vietnamese("alias"), "vi").otherwise("en").alias("language"), strip_accents(F.lower("alias")).alias("plain"), F.lit("accepted" if autowrite else "proposed").alias("action"))


def type_counts(skills: DataFrame) -> DataFrame:
    return skills.groupBy("skill_type").agg(F.count("*").alias("n"), F.count_if(F.col("skill_len") == 1).alias("n_single"), F.count_if(F.lower("skill_name").contains("certif")).alias("n_certificates"))
