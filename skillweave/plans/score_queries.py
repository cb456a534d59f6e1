"""Queries of retrieval scores, normalisation, features, ranking and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillweave.functions import location, text
from skillweave.operators import bm25, features, metrics, norm, occupation, ranker, skills
from skillweave.plans import sql
from skillweave.runtime import materialize, spread, table

Q, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def pairs(s, d):
    return features.keyed_pairs(table(s, d, "dataset_train"))


def _tokens_and_query(s, d):
    p = pairs(s, d)
    toks = materialize(p.select("grp", "row_id", text.tokens("resume_text").alias("toks")), "toks")
    jd = bm25.first_per_group(p, "grp", F.coalesce("job_description_text", F.lit("")), F.col("row_id"), "jd_text")
    return toks, bm25.query_terms(jd.select("grp", text.tokens("jd_text").alias("toks")))


_BASE = f"WITH pairs AS ({sql.PAIRS}), {sql.TOKS}, {sql.JD}"


@query("first_per_group", f"WITH pairs AS ({sql.PAIRS}) SELECT grp, arg_min(coalesce(jd_text,''), row_id) AS jd_text FROM pairs GROUP BY 1")
def _(s, d):
    return bm25.first_per_group(pairs(s, d), "grp", F.coalesce("job_description_text", F.lit("")), F.col("row_id"), "jd_text")


@query("bm25_stats", f"""WITH pairs AS ({sql.PAIRS}), {sql.TOKS}, n AS (SELECT grp, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM toks GROUP BY 1), df AS (SELECT grp, term, count(DISTINCT row_id) AS df FROM (SELECT grp, row_id, unnest(toks) AS term FROM toks) GROUP BY 1, 2),
i AS (SELECT grp, avg(ln(n_docs - df + 0.5) - ln(df + 0.5)) AS avg_idf FROM df JOIN n USING (grp) GROUP BY 1) SELECT grp, n_docs, round(avgdl, 6) AS avgdl, round(avg_idf, 6) + 0.0 AS avg_idf FROM n LEFT JOIN i USING (grp)""")
def _(s, d):
    t = materialize(pairs(s, d).select("grp", "row_id", text.tokens("resume_text").alias("toks")), "toks")
    return bm25.corpus_stats(t).select("grp", "n_docs", r6("avgdl").alias("avgdl"), r6("avg_idf").alias("avg_idf"))


@query("bm25_full", f"{_BASE}, {sql.bm25('toks', 'q', 'f')} SELECT grp, row_id, round(score, 6) + 0.0 AS score FROM f")
def _(s, d):
    toks, q = _tokens_and_query(s, d)
    return bm25.score(toks, q).select("grp", "row_id", r6("score").alias("score"))


@query("bm25_weighted", f"{_BASE}, w AS (SELECT grp, term, qtf * greatest(1, round_even(CASE WHEN len(term) >= 6 THEN len(term) / 4.0 ELSE 1 END, 0)) AS qtf FROM q), {sql.bm25('toks', 'w', 'f')} SELECT grp, row_id, round(score, 6) + 0.0 AS score FROM f")
def _(s, d):
    toks, q = _tokens_and_query(s, d)
    w = q.filter(F.length("term") >= 6).select("grp", "term", (F.length("term") / 4.0).alias("weight"))
    return bm25.score(toks, bm25.weighted(q, w)).select("grp", "row_id", r6("score").alias("score"))


_MM = "CASE WHEN count(*) OVER w <= 1 OR max(score) OVER w - min(score) OVER w <= 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-12) END"


@query("bm25_topk", f"""{_BASE}, {sql.bm25('toks', 'q', 'f')}, n AS (SELECT grp, row_id, {_MM} AS x FROM f WINDOW w AS (PARTITION BY grp)), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(x, 6) DESC, row_id) AS place, count(*) OVER (PARTITION BY grp) AS c FROM n)
SELECT grp, row_id, round(x, 6) + 0.0 AS score, place FROM r WHERE place <= 5 AND c >= 2""")
def bm25_topk(s, d):
    """Flagship: clean, tokenise, score by group, normalise, keep the best five."""
    toks, q = _tokens_and_query(s, d)
    n = norm.minmax(bm25.score(toks, q), "grp", "score", "x").select("grp", "row_id", r6("x").alias("score"))
    return ranker.rank(n, "grp", "score", "row_id", 5)


def full_dictionary(s, d):
    sp = table(s, d, "skills_processed").withColumn("bare", F.trim(F.regexp_replace("skill_name", r"\s*\([^)]*\)", "")))
    al = table(s, d, "skill_alias").groupBy("skill_id").agg(F.array_sort(F.collect_list("alias")).alias("al"))
    j = sp.join(al, "skill_id", "left")
    a = F.concat(F.when(F.col("abbreviation") != "", F.array("abbreviation")).otherwise(F.array().cast("array<string>")), F.coalesce("al", F.array().cast("array<string>")))
    return materialize(skills.alias_table(j.select(F.col("skill_id").alias("ord"), F.col("bare").alias("canonical"), a.alias("aliases"))), "aliases")


#: The dictionary as one alternation in its order, each phrase with a boundary of its own: where it begins or ends with a
#: word character the place must be a word boundary, elsewhere it must be none.
DICT = rf"""d0 AS (SELECT skill_id, trim(regexp_replace(skill_name,'\s*\([^)]*\)','','g')) AS bare, abbreviation FROM skills_processed), d1 AS (SELECT skill_id, list_sort(list(alias)) AS al FROM skill_alias GROUP BY 1),
d2 AS (SELECT skill_id, bare, list_concat([bare], CASE WHEN abbreviation <> '' THEN [abbreviation] ELSE [] END, coalesce(al, [])) AS a FROM d0 LEFT JOIN d1 USING (skill_id)), d3 AS (SELECT skill_id, bare, unnest(a) AS a, generate_subscripts(a, 1) AS pos FROM d2),
d4 AS (SELECT {sql.clean('bare')} AS canonical, {sql.clean('a')} AS alias, skill_id || chr(1) || lpad(CAST(pos AS VARCHAR), 6, '0') AS place FROM d3), dict AS (SELECT alias, arg_max(canonical, place) AS canonical, min(place) AS rank FROM d4 WHERE alias <> '' GROUP BY 1),
pat AS (SELECT string_agg(CASE WHEN regexp_matches(alias,'^[A-Za-z0-9_]') THEN '\b' ELSE '\B' END || regexp_escape(alias) || CASE WHEN regexp_matches(alias,'[A-Za-z0-9_]$') THEN '\b' ELSE '\B' END, '|' ORDER BY rank) AS p FROM dict)"""


def sql_skills(src: str, key: str, text_sql: str, out: str) -> str:
    """CTEs that end in ``out`` (key, skills): the sorted distinct skills of every row of ``src``."""
    return f"""{out}_h AS (SELECT {key}, unnest(list_distinct(regexp_extract_all({text_sql}, pat.p))) AS alias FROM {src}, pat), {out}_g AS (SELECT {key}, list_sort(list(DISTINCT canonical)) AS skills FROM {out}_h JOIN dict USING (alias) GROUP BY 1),
{out} AS (SELECT {key}, coalesce(skills, []) AS skills FROM (SELECT DISTINCT {key} FROM {src}) LEFT JOIN {out}_g USING ({key}))"""


def pair_skills(s, d):
    p, a = pairs(s, d), full_dictionary(s, d)
    cv = skills.extract(p.select(F.col("row_id").alias("doc_id"), text.clean_text("resume_text").alias("text")), a).withColumnRenamed("doc_id", "row_id")
    jd = bm25.first_per_group(p, "grp", F.coalesce("job_description_text", F.lit("")), F.col("row_id"), "jd_text")
    js = skills.extract(jd.select(F.col("grp").alias("doc_id"), text.clean_text("jd_text").alias("text")), a).withColumnsRenamed({"doc_id": "grp", "skills": "wanted"})
    return materialize(p.select("grp", "row_id").join(cv, "row_id").join(js, "grp"), "pair-skills")


_SK = f"""WITH pairs AS ({sql.PAIRS}), {DICT}, jd0 AS (SELECT grp, arg_min(coalesce(jd_text,''), row_id) AS jd_text FROM pairs GROUP BY 1), {sql_skills('jd0', 'grp', sql.clean('jd_text'), 'js')}, {sql_skills('pairs', 'row_id', sql.clean('resume_text'), 'cs')},
jsk AS (SELECT grp, skills AS wanted FROM js), sk AS (SELECT grp, row_id, skills, wanted FROM pairs JOIN cs USING (row_id) JOIN jsk USING (grp))"""


@query("skill_words", f"{_SK} SELECT row_id, array_to_string(skills,',') AS skills, array_to_string(wanted,',') AS wanted FROM sk")
def _(s, d):
    return pair_skills(s, d).select("row_id", F.array_join("skills", ",").alias("skills"), F.array_join("wanted", ",").alias("wanted"))


@query("skill_extract", f"WITH {DICT}, {sql_skills('documents', 'doc_id', sql.clean('text'), 'x')} SELECT doc_id, CAST(len(skills) AS INT) AS n, array_to_string(skills,',') AS skills FROM x")
def _(s, d):
    t = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", text.clean_text("text").alias("text"))
    return skills.extract(t, full_dictionary(s, d)).select("doc_id", F.size("skills").alias("n"), F.array_join("skills", ",").alias("skills"))


@query("fuzzy_candidates", rf"""WITH {DICT}, al AS (SELECT list(alias) AS known FROM dict), t AS (SELECT doc_id, {sql.tokens('text')} AS t FROM documents), g AS (SELECT doc_id, n, i, array_to_string(t[i : i + n - 1], ' ') AS gram FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, range(1, 5) r(n))),
f AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY min(n), min(i)) AS pos FROM g, al WHERE len(gram) BETWEEN 2 AND 64 AND NOT list_contains(known, gram) GROUP BY doc_id, gram) SELECT doc_id, pos - 1 AS pos, gram FROM f WHERE pos <= 500""")
def _(s, d):
    """The phrases that the fuzzy tier looks up: the first 500 of each text in order."""
    t = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", text.clean_text("text").alias("text"))
    return skills.candidates(t, full_dictionary(s, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "gram")


@query("skill_extract_fuzzy")
def _(s, d):
    """Both tiers, with the hashed stand-in for the encoder."""
    t = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", text.clean_text("text").alias("text"))
    x = skills.extract(t, full_dictionary(s, d), skills.FuzzyTier(features.HashedEmbedder(256)))
    return x.select("doc_id", F.size("skills").alias("n"), F.array_join("skills", ",").alias("skills"))


@query("vendor_cov", f"{_SK} SELECT row_id, round(CASE WHEN len(wanted) = 0 THEN 0 ELSE (len(list_intersect(skills, wanted)) + 1.0) / (len(wanted) + 2.0) END, 6) AS cov, array_to_string(list_sort(list_intersect(skills, wanted)), ',') AS shared, round(len(list_intersect(skills, wanted)) / greatest(len(list_distinct(list_concat(skills, wanted))), 1), 6) AS jaccard FROM sk")
def _(s, d):
    p = pair_skills(s, d)
    return p.select("row_id", r6(skills.coverage(F.col("skills"), F.col("wanted"))).alias("cov"), F.array_join(F.array_sort(F.array_intersect("skills", "wanted")), ",").alias("shared"), r6(skills.jaccard(F.col("skills"), F.col("wanted"))).alias("jaccard"))


@query("skill_occurrences", f"{_SK} SELECT unnest(skills) AS skill, count(*) AS n FROM sk GROUP BY 1")
def _(s, d):
    return pair_skills(s, d).select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


@query("prf1", f"""{_SK}, g AS (SELECT DISTINCT row_id, unnest(wanted) AS k FROM sk), f AS (SELECT DISTINCT row_id, unnest(skills) AS k FROM sk), t AS (SELECT count(*) FILTER (g.k IS NOT NULL AND f.k IS NOT NULL) AS tp, count(*) FILTER (g.k IS NULL) AS fp, count(*) FILTER (f.k IS NULL) AS fn FROM g FULL JOIN f ON g.row_id = f.row_id AND g.k = f.k)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""")
def _(s, d):
    p = pair_skills(s, d)
    m = metrics.micro_prf(p.select("row_id", F.explode("wanted").alias("k")), p.select("row_id", F.explode("skills").alias("k")), ["row_id", "k"])
    return m.select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("bm25_skills", f"{_SK}, sd AS (SELECT grp, row_id, skills AS toks FROM sk), sq AS (SELECT grp, unnest(wanted) AS term, 1 AS qtf FROM jsk), {sql.bm25('sd', 'sq', 'f')} SELECT grp, row_id, round(score, 6) + 0.0 AS score FROM f")
def _(s, d):
    p = pair_skills(s, d)
    q = p.select("grp", "wanted").distinct().select("grp", F.explode("wanted").alias("term")).withColumn("qtf", F.lit(1))
    return bm25.score(p.select("grp", "row_id", F.col("skills").alias("toks")), q).select("grp", "row_id", r6("score").alias("score"))


_COMBO = f"""{_SK}, {sql.TOKS}, {sql.JD}, sd AS (SELECT grp, row_id, skills AS toks FROM sk), sq AS (SELECT grp, unnest(wanted) AS term, 1 AS qtf FROM jsk), {sql.bm25('toks', 'q', 'f')}, {sql.bm25('sd', 'sq', 'g')},
fn AS (SELECT grp, row_id, {_MM} AS x FROM f WINDOW w AS (PARTITION BY grp)), gn AS (SELECT grp, row_id, {_MM} AS y FROM g WINDOW w AS (PARTITION BY grp)),
a AS (SELECT fn.grp, row_id, x, y, 0.5 * x + 0.5 * y AS combo, CASE WHEN len(wanted) = 0 THEN 0 ELSE (len(list_intersect(skills, wanted)) + 1.0) / (len(wanted) + 2.0) END AS cov FROM fn JOIN gn USING (row_id) JOIN sk USING (row_id))"""


@query("features", f"{_COMBO} SELECT row_id, round(cov, 6) AS vendor_cov, round(x, 6) + 0.0 AS bm25_full_norm, round(y, 6) + 0.0 AS bm25_skills_norm, round(combo, 6) + 0.0 AS bm25_combo, round(0.5 * cov + 0.5 * combo, 6) + 0.0 AS final_score FROM a")
def _(s, d):
    f = features.build(table(s, d, "dataset_train"), full_dictionary(s, d))
    return f.select("row_id", *[r6(c).alias(c) for c in ("vendor_cov", "bm25_full_norm", "bm25_skills_norm", "bm25_combo", "final_score")])


@query("emb_cosine")
def _(s, d):
    p = features.keyed_pairs(table(s, d, "dataset_train")).filter("job_description_text IS NOT NULL AND resume_text IS NOT NULL")
    return features.cosine_feature(p, features.HashedEmbedder()).select("row_id", r6("emb_cosine").alias("emb_cosine"), r6("emb_cosine_norm").alias("emb_cosine_norm"))


def scored(s, d, col="vendor_cov"):
    f = table(s, d, "features").filter(F.col(col).isNotNull() & ~F.isnan(col))
    return f.select("jd_id", "cv_id", F.col(col).alias("x"), "computed_at", F.concat_ws("|", "cv_id", F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss")).alias("rid"))


_SC = "s AS (SELECT jd_id, cv_id, vendor_cov AS score, computed_at, cv_id || '|' || strftime(computed_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS rid FROM features WHERE vendor_cov IS NOT NULL AND NOT isnan(vendor_cov))"
_W = "WINDOW w AS (PARTITION BY jd_id)"


def _norm_query(name, fn, expr):
    @query(name, f"WITH {_SC} SELECT jd_id, rid, round({expr}, 6) + 0.0 AS v FROM s {_W}")
    def run(s, d):
        return fn(scored(s, d)).select("jd_id", "rid", r6("v").alias("v"))

    return run


_norm_query("norm_minmax", lambda t: norm.minmax(t, "jd_id", "x", "v"), _MM)
_norm_query("norm_zscore", lambda t: norm.zscore(t, "jd_id", "x", "v"), "CASE WHEN count(*) OVER w <= 1 THEN 0 ELSE (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-12) END")
_norm_query("norm_rank", lambda t: norm.rank(t, "jd_id", "x", "v", "rid"), "CASE WHEN count(*) OVER w <= 1 THEN 0 ELSE (row_number() OVER (PARTITION BY jd_id ORDER BY score, rid) - 1.0) / (count(*) OVER w - 1) END")


@query("norm_softmax", f"WITH {_SC}, e AS (SELECT jd_id, rid, exp(score - max(score) OVER w) AS e FROM s {_W}) SELECT jd_id, rid, round(e / (sum(e) OVER (PARTITION BY jd_id) + 1e-12), 6) + 0.0 AS v FROM e")
def _(s, d):
    return norm.softmax(scored(s, d), "jd_id", "x", "v").select("jd_id", "rid", r6("v").alias("v"))


@query("label_encode", "SELECT row_id, CAST(label - (SELECT min(label) FROM dataset_train) AS INT) AS y FROM dataset_train")
def _(s, d):
    return ranker.encode_labels(table(s, d, "dataset_train"), "label").select("row_id", "y")


@query("group_sizes", f"WITH pairs AS ({sql.PAIRS}) SELECT grp, count(*) AS n FROM pairs GROUP BY 1")
def _(s, d):
    return pairs(s, d).groupBy("grp").agg(F.count("*").alias("n"))


@query("valid_groups", f"WITH pairs AS ({sql.PAIRS}) SELECT grp, row_id FROM pairs WHERE label IS NOT NULL QUALIFY count(*) OVER (PARTITION BY grp) >= 2 AND max(label) OVER (PARTITION BY grp) > min(label) OVER (PARTITION BY grp)")
def _(s, d):
    return ranker.valid_groups(pairs(s, d).filter("label IS NOT NULL"), "grp", "label").select("grp", "row_id")


_GOLD = "gold AS (SELECT lower(trim(jd_id)) AS jd_id, lower(trim(cv_id)) AS cv_id, max(label) AS grade FROM dataset_train WHERE jd_id IS NOT NULL AND cv_id IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)"


def gold(s, d):
    t = table(s, d, "dataset_train").filter("jd_id IS NOT NULL AND cv_id IS NOT NULL AND label IS NOT NULL")
    return t.groupBy(F.lower(F.trim("jd_id")).alias("jd_id"), F.lower(F.trim("cv_id")).alias("cv_id")).agg(F.max("label").alias("grade"))


@query("gold_grades", f"WITH {_GOLD} SELECT jd_id, count(*) AS n, count(*) FILTER (grade >= 2) AS strict, count(*) FILTER (grade >= 1) AS relaxed FROM gold GROUP BY 1")
def _(s, d):
    return gold(s, d).groupBy("jd_id").agg(F.count("*").alias("n"), F.count_if(F.col("grade") >= 2).alias("strict"), F.count_if(F.col("grade") >= 1).alias("relaxed"))


_ONE = "one AS (SELECT jd_id, cv_id, max(final_score) AS pred FROM features WHERE final_score IS NOT NULL AND NOT isnan(final_score) GROUP BY 1, 2)"


def one_score(s, d):
    return table(s, d, "features").filter("final_score IS NOT NULL AND NOT isnan(final_score)").groupBy("jd_id", "cv_id").agg(F.max("final_score").alias("pred"))


@query("features_with_labels", f"WITH {_GOLD}, {_ONE} SELECT jd_id, cv_id, pred, grade FROM one LEFT JOIN gold USING (jd_id, cv_id)")
def features_with_labels(s, d):
    return one_score(s, d).join(gold(s, d), ["jd_id", "cv_id"], "left").select("jd_id", "cv_id", "pred", "grade")


_FL = f"WITH {_GOLD}, {_ONE}, l AS (SELECT jd_id, cv_id, pred, grade FROM one JOIN gold USING (jd_id, cv_id))"


def labelled(s, d):
    return one_score(s, d).join(gold(s, d), ["jd_id", "cv_id"])


@query("rank_topk", f"WITH {_ONE} SELECT jd_id, cv_id, pred, place FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY pred DESC, cv_id) AS place, count(*) OVER (PARTITION BY jd_id) AS c FROM one) WHERE place <= 10 AND c >= 2")
def _(s, d):
    return ranker.rank(one_score(s, d), "jd_id", "pred", "cv_id", 10)


@query("topk_report", f"""WITH {_ONE}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY pred DESC, cv_id) AS place, count(*) OVER (PARTITION BY jd_id) AS c FROM one) WHERE place <= 3 AND c >= 2),
t AS (SELECT lower(trim(jd_id)) AS jd_id, lower(trim(cv_id)) AS cv_id, arg_min(coalesce(resume_text,''), row_id) AS txt FROM dataset_train WHERE jd_id IS NOT NULL AND cv_id IS NOT NULL GROUP BY 1, 2) SELECT jd_id, cv_id, place, substring(txt, 1, 200) AS preview FROM r JOIN t USING (jd_id, cv_id)""")
def _(s, d):
    t = table(s, d, "dataset_train").filter("jd_id IS NOT NULL AND cv_id IS NOT NULL").groupBy(F.lower(F.trim("jd_id")).alias("jd_id"), F.lower(F.trim("cv_id")).alias("cv_id")).agg(F.min_by(F.substring(F.coalesce("resume_text", F.lit("")), 1, 200), "row_id").alias("preview"))
    return ranker.rank(one_score(s, d), "jd_id", "pred", "cv_id", 3).join(t, ["jd_id", "cv_id"]).select("jd_id", "cv_id", "place", "preview")


_ND = """, o AS (SELECT jd_id, cv_id, pred, dense_rank() OVER (PARTITION BY jd_id ORDER BY grade) - 1 AS ord, count(*) OVER (PARTITION BY jd_id) AS n FROM l), p AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY pred DESC, cv_id) AS pos, row_number() OVER (PARTITION BY jd_id ORDER BY ord DESC, cv_id) AS best FROM o WHERE n >= 2),
nd AS (SELECT jd_id, count(*) AS n, sum(CASE WHEN pos <= 10 THEN (2.0**ord - 1) / log2(pos + 1) ELSE 0 END) / (sum(CASE WHEN best <= 10 THEN (2.0**ord - 1) / log2(best + 1) ELSE 0 END) + 1e-12) AS ndcg FROM p GROUP BY 1)"""


@query("ndcg_group", f"{_FL}{_ND} SELECT jd_id, n, round(ndcg, 6) + 0.0 AS ndcg FROM nd")
def _(s, d):
    return metrics.ndcg(labelled(s, d), "jd_id", "pred", "grade", "cv_id", 10).select("jd_id", "n", r6("ndcg").alias("ndcg"))


@query("ranking_metrics", f"{_FL}{_ND} SELECT count(*) AS groups, round(sum(n * ndcg) / (sum(n) + 1e-12), 4) AS ndcg_w, round(avg(ndcg), 4) AS ndcg_mean FROM nd")
def _(s, d):
    m = metrics.ndcg(labelled(s, d), "jd_id", "pred", "grade", "cv_id", 10)
    return m.agg(F.count("*").alias("groups"), F.round(metrics.weighted_mean(m, "ndcg", "n"), 4).alias("ndcg_w"), F.round(F.avg("ndcg"), 4).alias("ndcg_mean"))


@query("corr_metrics", f"""{_FL}, r AS (SELECT jd_id, pred, grade, rank() OVER (PARTITION BY jd_id ORDER BY pred) + (count(*) OVER (PARTITION BY jd_id, pred) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY jd_id ORDER BY grade) + (count(*) OVER (PARTITION BY jd_id, grade) - 1) / 2.0 AS ry FROM l)
SELECT jd_id, count(*) AS n, CASE WHEN min(pred) < max(pred) AND min(grade) < max(grade) THEN round(corr(pred, grade), 6) END AS pearson, CASE WHEN min(pred) < max(pred) AND min(grade) < max(grade) THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY 1""")
def _(s, d):
    c = metrics.correlations(labelled(s, d), "jd_id", "pred", "grade")
    return c.select("jd_id", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


def _auc_sql(t: str) -> str:
    return f"""(SELECT sum(p * (below + neg / 2.0)) / (sum(p) * sum(neg)) AS roc_auc, sum(p * cp / cn) / sum(p) AS ap FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY pred DESC) AS cp, sum(n) OVER (ORDER BY pred DESC) AS cn
FROM (SELECT pred, count(*) FILTER (grade >= {t}) AS p, count(*) FILTER (grade < {t}) AS neg, count(*) AS n FROM l GROUP BY 1)))"""


@query("auc_metrics", f"{_FL} SELECT 'strict' AS kind, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM {_auc_sql('2')} UNION ALL SELECT 'relaxed', round(roc_auc, 6), round(ap, 6) FROM {_auc_sql('1')}")
def _(s, d):
    t = labelled(s, d)
    one = lambda k, c: metrics.auc(t, "pred", F.col("grade") >= c).select(F.lit(k).alias("kind"), r6("roc_auc").alias("roc_auc"), r6("average_precision").alias("average_precision"))
    return one("strict", 2).unionByName(one("relaxed", 1))


@query("retrieval_eval", f"""{_FL}, r AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY pred DESC, cv_id) AS pos FROM l), g AS (SELECT jd_id, count(*) FILTER (grade >= 1) AS p, count(*) FILTER (grade >= 1 AND pos <= 5) AS h, min(pos) FILTER (grade >= 1 AND pos <= 5) AS f FROM r GROUP BY 1)
SELECT count(*) AS groups, round(avg(h / p), 6) AS recall_5, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr_5 FROM g WHERE p > 0""")
def _(s, d):
    r = norm.place(labelled(s, d), "jd_id", [F.col("pred").desc(), F.col("cv_id").asc()], "p0").withColumn("pos", F.col("p0") + 1)
    m = metrics.recall_mrr(r, "jd_id", "pos", F.col("grade") >= 1, 5)
    return m.agg(F.count("*").alias("groups"), r6(F.avg("recall")).alias("recall_5"), r6(F.avg("mrr")).alias("mrr_5"))


@query("ltr_rank")
def _(s, d):
    """Fits the ranker on a bounded sample and ranks all candidates with it."""
    cfg = ranker.RankerConfig(features=("vendor_cov", "bm25_full_norm", "bm25_skills_norm", "bm25_combo", "emb_cosine_norm"), n_trees=30)
    f = table(s, d, "features")
    one = f.groupBy("jd_id", "cv_id").agg(*[F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in cfg.features])
    t = one.join(gold(s, d), ["jd_id", "cv_id"]).filter(~ranker.group_split(one, "jd_id"))
    m = ranker.LambdaMart(cfg).fit(t, "jd_id", "grade")
    return ranker.rank(m.predict(one), "jd_id", "pred", "cv_id", 5).select("jd_id", "cv_id", r6("pred").alias("pred"), "place")


def _norm_place(x: str) -> str:
    return f"strip_accents(lower({sql.collapse(x)}))"


def _part(parts: str, i: int) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({parts}[{i}],''),'\b(?:city|province|state|district)\b','','g'),'\s+',' ','g'))"


_REMOTE = "(contains({0},'remote') OR contains({0},'work from home') OR contains({0},'wfh') OR contains({0},'fully remote'))"
_LOC = f"""WITH n AS (SELECT c.rev_id, {_norm_place('j.description')} AS jt, {_norm_place('j.job_location')} AS jl, {_norm_place('c.cv_location')} AS cl FROM cv c LEFT JOIN (SELECT *, row_number() OVER (ORDER BY rev_id) - 1 AS post FROM job) j ON j.post = (c.rev_id - 1) % (SELECT count(*) FROM job)),
p AS (SELECT *, list_filter(list_transform(string_split(jl,','), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(cl,','), lambda x: trim(x)), lambda x: x <> '') AS b FROM n),
q AS (SELECT *, {_part('a', 1)} AS ac, {_part('a', 2)} AS ap, coalesce(a[-1],'') AS ak, {_part('b', 1)} AS bc, {_part('b', 2)} AS bp, coalesce(b[-1],'') AS bk FROM p),
loc AS (SELECT rev_id, CAST(CASE WHEN {_REMOTE.format('jt')} OR {_REMOTE.format('jl')} THEN 1.0 WHEN jl = '' THEN 1.0 WHEN cl = '' THEN 0.85 WHEN ac <> '' AND ac = bc THEN 1.0 WHEN ap <> '' AND ap = bp THEN 0.9 WHEN ak <> '' AND ak = bk THEN 0.8 ELSE 0.6 END AS DOUBLE) AS loc FROM q)"""


def places(s, d):
    """Every cv row with one post: posts are numbered by rev_id and dealt to the rows by (rev_id - 1) modulo their
    number, as the tables have no link of their own."""
    from skillweave.functions.ids import rank_globally

    c = table(s, d, "cv").select("rev_id", "cv_location", "skills")
    j = rank_globally(table(s, d, "job").select(F.col("rev_id").alias("job_id"), "description", "job_location"), [F.col("job_id").asc()], "post")
    c = c.withColumn("post", F.pmod(F.col("rev_id") - 1, F.lit(max(j.count(), 1))))
    return c.join(j, "post", "left").select("rev_id", F.coalesce(F.size("skills"), F.lit(0)).alias("n_skills"), location.score_pair("description", "job_location", "cv_location").alias("loc"))


@query("location_score", f"{_LOC} SELECT rev_id, loc FROM loc")
def _(s, d):
    return places(s, d).select("rev_id", "loc")


@query("location_blend", f"{_LOC} SELECT rev_id, round(0.9 * (coalesce(len(skills), 0) / 20.0) + 0.1 * loc, 6) AS score FROM loc JOIN cv USING (rev_id)")
def _(s, d):
    return places(s, d).select("rev_id", r6(location.blend(F.greatest("n_skills", F.lit(0)) / 20.0, F.col("loc"))).alias("score"))


@query("location_tiebreak", f"{_LOC} SELECT rev_id, row_number() OVER (ORDER BY coalesce(len(skills), 0) DESC, loc DESC, rev_id) - 1 AS place FROM loc JOIN cv USING (rev_id)")
def _(s, d):
    from skillweave.functions.ids import rank_globally

    p = places(s, d).withColumn("n_skills", F.greatest("n_skills", F.lit(0)))
    return rank_globally(p, [F.col("n_skills").desc(), F.col("loc").desc(), F.col("rev_id").asc()], "place").select("rev_id", "place")


_TF = r"""regexp_extract_all(lower({}),'[a-z0-9]+')"""


@query("tfidf_topk", f"""WITH dt AS (SELECT skill_id AS doc_id, unnest({_TF.format('skill_name')}) AS term FROM skills_processed), n AS (SELECT count(*) AS n FROM skills_processed), df AS (SELECT term, count(DISTINCT doc_id) AS df, max(n) AS n FROM dt, n GROUP BY 1 HAVING count(DISTINCT doc_id) <= 0.8 * max(n)),
w0 AS (SELECT doc_id, term, count(*) * (ln((1 + n) / (1 + df)) + 1) AS w FROM dt JOIN df USING (term) GROUP BY doc_id, term, n, df), w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0),
qt AS (SELECT item_id AS query_id, unnest({_TF.format('text')}) AS term FROM eval_item), v0 AS (SELECT query_id, term, count(*) * (ln((1 + n) / (1 + df)) + 1) AS v FROM qt JOIN df USING (term) GROUP BY query_id, term, n, df), v AS (SELECT query_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS v FROM v0),
s AS (SELECT query_id, doc_id, sum(w * v) AS score FROM w JOIN v USING (term) GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s) WHERE place <= 5""")
def _(s, d):
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    c = table(s, d, "skills_processed").select(F.col("skill_id").alias("doc_id"), F.col("skill_name").alias("text"))
    q = table(s, d, "eval_item").select(F.col("item_id").alias("query_id"), "text")
    return occupation.tfidf_topk(c, q, toks).select("query_id", "doc_id", r6("score").alias("score"), "place")


@query("occupation_topk")
def _(s, d):
    occ = table(s, d, "job").filter("title IS NOT NULL").groupBy(text.slugify("title").alias("occ_id")).agg(F.min_by("title", "rev_id").alias("label")).withColumn("text", F.col("label"))
    q = table(s, d, "eval_item").select(F.col("item_id").alias("query_id"), "text")
    return occupation.simple_topk(q, occ).select("query_id", "occ_id", r6("score").alias("score"), "place")


def packs(s, d):
    j = table(s, d, "job").filter("title IS NOT NULL AND skills IS NOT NULL").select(text.slugify("title").alias("slug"), F.posexplode("skills").alias("pos", "canonical")).filter("canonical IS NOT NULL")
    return j.groupBy("slug", F.when(F.col("pos") < 3, "essential").otherwise("optional").alias("bucket"), "canonical").agg(F.array_sort(F.collect_set(F.lower("canonical"))).alias("aliases"))


@query("pack_buckets", "SELECT canonical, CASE WHEN min(pos) < 4 THEN 'essential' ELSE 'optional' END AS bucket FROM (SELECT unnest(skills) AS canonical, generate_subscripts(skills, 1) AS pos FROM job WHERE title IS NOT NULL AND skills IS NOT NULL) WHERE canonical IS NOT NULL GROUP BY 1")
def _(s, d):
    p = materialize(packs(s, d), "packs")
    return occupation.pack_buckets(p, p.select("slug").distinct())
