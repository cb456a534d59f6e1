"""Queries that once did less than their whole job."""

import re

import pytest
from pyspark.sql import functions as F

from skillweave.functions import text
from skillweave.plans import score_queries

SF = "/root/testdata/sf0.001"


# the full dictionary ------------------------------------------------------------------------------


def phrases(spark):
    """A function from a cleaned text to its skills by one alternation over all aliases in dictionary order."""
    sp = spark.read.parquet(f"{SF}/skills_processed.parquet").orderBy("skill_id").collect()
    al = {r["skill_id"]: sorted(r["al"]) for r in spark.read.parquet(f"{SF}/skill_alias.parquet").groupBy("skill_id").agg(F.collect_list("alias").alias("al")).collect()}
    rows = []
    for r in sp:
        name = re.sub(r"\s*\([^)]*\)", "", r["skill_name"]).strip()
        rows += [(name, a) for a in (name, *([r["abbreviation"]] if r["abbreviation"] else []), *al.get(r["skill_id"], []))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, a string")
    rows = [(r["c"], r["a"]) for r in df.select("i", text.clean_text("c").alias("c"), text.clean_text("a").alias("a")).orderBy("i").collect() if r["a"]]
    canon = {a: c for c, a in rows}
    every = re.compile("|".join(rf"(?<![A-Za-z0-9_]){re.escape(a)}(?![A-Za-z0-9_])" for _, a in rows))
    return lambda t: {canon[m.group()] for m in every.finditer(t)}


def test_pair_skills_use_the_full_dictionary(spark):
    find = phrases(spark)
    p = score_queries.pairs(spark, SF).select("row_id", "grp", text.clean_text("resume_text").alias("t"), text.clean_text("job_description_text").alias("j")).collect()
    first = {r["grp"]: r["j"] for r in sorted(p, key=lambda r: -r["row_id"])}
    got = {r["row_id"]: r for r in score_queries.Q["skill_words"](spark, SF).collect()}
    assert len(got) == len(p)
    seen = set()
    for r in p:
        seen |= find(r["t"])
        assert find(r["t"]) <= set(got[r["row_id"]]["skills"].split(","))
        assert find(first[r["grp"]]) <= set(got[r["row_id"]]["wanted"].split(","))
    assert any(" " in s for s in seen)  # names of several words are among them
    cov = {r["row_id"]: r["cov"] for r in score_queries.Q["vendor_cov"](spark, SF).collect()}
    whole = {r["row_id"]: r["vendor_cov"] for r in score_queries.Q["features"](spark, SF).collect()}
    for k, r in got.items():
        s, w = set(filter(None, r["skills"].split(","))), set(filter(None, r["wanted"].split(",")))
        assert cov[k] == pytest.approx((len(s & w) + 1) / (len(w) + 2) if w else 0, abs=1e-6)
        assert whole[k] == cov[k]


# places -------------------------------------------------------------------------------------------


def test_every_cv_row_is_scored_with_a_post(spark):
    cv = sorted(r["rev_id"] for r in spark.read.parquet(f"{SF}/cv.parquet").collect())
    n = spark.read.parquet(f"{SF}/job.parquet").count()
    assert len(cv) > n
    p = score_queries.places(spark, SF).collect()
    assert sorted(r["rev_id"] for r in p) == cv and all(r["loc"] is not None for r in p)
    place = score_queries.Q["location_tiebreak"](spark, SF).collect()
    assert sorted(r["place"] for r in place) == list(range(len(cv)))
