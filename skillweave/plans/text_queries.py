"""Queries of the text, identifier and dictionary functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillweave.functions import ids, text
from skillweave.operators import dictionary, skills
from skillweave.plans import sql
from skillweave.runtime import spread, table

Q, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("clean_text", f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.clean_text("text").alias("cleaned"))


@query("tokens", f"SELECT row_id, len(t) AS n_tokens, array_to_string(t, ' ') AS toks FROM (SELECT row_id, {sql.tokens('resume_text')} AS t FROM dataset_train)")
def _(s, d):
    t = table(s, d, "dataset_train").select("row_id", text.tokens("resume_text").alias("t"))
    return t.select("row_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("toks"))


@query("ngrams", f"""WITH t AS (SELECT {sql.tokens('description')} AS t FROM job), g AS (SELECT t[i] || ' ' || t[i+1] AS gram FROM (SELECT t, unnest(range(1, len(t))) AS i FROM t))
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def _(s, d):
    t = table(s, d, "job").select(text.tokens("description").alias("t"))
    return t.select(F.explode(text.ngrams("t", 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("ascii_clean", r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text,''),'[^\x00-\x7F]+',' ','g'),'\s+',' ','g')) AS t FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.ascii_clean("text").alias("t"))


@query("clean_label", r"SELECT skill_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(skill_name),'\([^()]*\)|\[[^\[\]]*\]',' ','g'),'[^a-z0-9\s]+',' ','g'),'\s+',' ','g')) AS label FROM skills_processed")
def _(s, d):
    return table(s, d, "skills_processed").select("skill_id", text.clean_label("skill_name").alias("label"))


@query("abbreviation", r"SELECT skill_id, CASE WHEN regexp_matches(x,'^[A-Z0-9-]+$') THEN x ELSE '' END AS abbreviation FROM (SELECT skill_id, trim(regexp_extract(skill_name,'\(([^)]*)\)',1)) AS x FROM skills_processed)")
def _(s, d):
    return table(s, d, "skills_processed").select("skill_id", text.abbreviation("skill_name").alias("abbreviation"))


@query("strip_accents", "SELECT doc_id, strip_accents(coalesce(text,'')) AS plain FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.strip_accents("text").alias("plain"))


@query("slugify", r"SELECT rev_id, CASE WHEN x = '' THEN 'unknown' ELSE x END AS slug FROM (SELECT rev_id, regexp_replace(regexp_replace(lower(translate(strip_accents(coalesce(cv_location,'')),'đĐ','dD')),'[^a-z0-9]+','_','g'),'^_+|_+$','','g') AS x FROM cv)")
def _(s, d):
    return table(s, d, "cv").select("rev_id", text.slugify("cv_location").alias("slug"))


_NT = sql.collapse(r"regexp_replace(regexp_replace(lower(coalesce(summary,'')),'\([^)]*\)|\[[^\]]*\]|\{[^}]*\}',' ','g'),'[^\p{L}\p{M}\p{N}_\s+#.-]',' ','g')")


@query("normalize_text", f"SELECT rev_id, {_NT} AS t FROM cv")
def _(s, d):
    return table(s, d, "cv").select("rev_id", text.normalize_text("summary").alias("t"))


@query("clean_html")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.clean_html("text").alias("cleaned"))


@query("stem_names")
def _(s, d):
    return table(s, d, "skills_processed").select("skill_id", text.stem("skill_cleaned").alias("stemmed"))


@query("flags", f"""SELECT skill_id, len(l) >= 2 AND regexp_matches(l,'^\\p{{Lu}}+$') AS acronym, NOT regexp_matches(t,'[^\\x00-\\x7F]') AND (len(t) > 2 OR t IN ('c#','c++','go')) AS ascii_english,
regexp_matches(lower(alias),'[{text.VIETNAMESE_LETTERS}]') AS vietnamese, regexp_matches(alias,'^[0-9.]+$') AS numeric_only FROM (SELECT skill_id, alias, regexp_replace(alias,'[^\\p{{L}}]','','g') AS l, lower(trim(alias)) AS t FROM
(SELECT skill_id, alias FROM skill_alias UNION ALL SELECT skill_id, skill_name FROM skills_processed UNION ALL SELECT skill_id, abbreviation FROM skills_processed))""")
def _(s, d):
    sp = table(s, d, "skills_processed")
    a = table(s, d, "skill_alias").select("skill_id", "alias").unionByName(sp.select("skill_id", F.col("skill_name").alias("alias"))).unionByName(sp.select("skill_id", F.col("abbreviation").alias("alias")))
    return a.select("skill_id", text.is_acronym("alias").alias("acronym"), text.is_ascii_english("alias").alias("ascii_english"), text.looks_vietnamese("alias").alias("vietnamese"), F.col("alias").rlike(r"^[0-9.]+$").alias("numeric_only"))


def _n(x: str) -> str:
    return sql.collapse(f"lower(coalesce({x},''))")


@query("stable_ids", f"""SELECT row_id, 'jd-' || substring(sha1({_n('job_description_text')}),1,12) AS jd_key, 'cv-' || substring(sha1({_n('resume_text')}),1,12) AS cv_key,
'cv-' || substring(sha1(coalesce(resume_text,'')),1,10) AS raw_key FROM dataset_train""")
def _(s, d):
    return table(s, d, "dataset_train").select("row_id", ids.stable_id("job_description_text", "jd").alias("jd_key"), ids.stable_id("resume_text", "cv").alias("cv_key"), ids.raw_id("resume_text").alias("raw_key"))


@query("factorize_ids", "WITH f AS (SELECT job_description_text AS k, min(row_id) AS o FROM dataset_train GROUP BY 1), c AS (SELECT k, row_number() OVER (ORDER BY o) - 1 AS code FROM f) SELECT row_id, code FROM dataset_train t JOIN c ON t.job_description_text IS NOT DISTINCT FROM c.k")
def _(s, d):
    return ids.dense_code(table(s, d, "dataset_train"), F.col("job_description_text"), F.col("row_id"), "code").select("row_id", "code")


@query("per_group_ids", "SELECT row_id, 'jd' || grp || '-cv-' || lpad(CAST(row_number() OVER (PARTITION BY grp ORDER BY row_id) - 1 AS VARCHAR), 6, '0') AS cv_key FROM (SELECT row_id, lower(trim(jd_id)) AS grp FROM dataset_train WHERE jd_id IS NOT NULL)")
def _(s, d):
    from skillweave.operators.norm import place

    t = table(s, d, "dataset_train").filter("jd_id IS NOT NULL").select("row_id", F.lower(F.trim("jd_id")).alias("grp"))
    p = place(t, "grp", [F.col("row_id").asc()], "n")
    return p.select("row_id", F.concat(F.lit("jd"), "grp", F.lit("-cv-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("cv_key"))


@query("text_index", "SELECT job_description_text AS t, row_number() OVER (ORDER BY job_description_text) - 1 AS idx FROM (SELECT DISTINCT job_description_text FROM dataset_train WHERE job_description_text IS NOT NULL)")
def _(s, d):
    t = table(s, d, "dataset_train").select(F.col("job_description_text").alias("t")).filter("t IS NOT NULL").distinct()
    return ids.rank_globally(t, [F.col("t")], "idx")


@query("merge_jd", r"SELECT rev_id, CASE WHEN a <> '' AND b <> '' THEN a || chr(10) || chr(10) || b ELSE a || b END AS jd FROM (SELECT rev_id, trim(coalesce(title,'')) AS a, trim(coalesce(description,'')) AS b FROM job)")
def _(s, d):
    return table(s, d, "job").select("rev_id", text.merge_jd("title", "description").alias("jd"))


@query("token_dist", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(skill_stemmed,' ')) AS token FROM skills_processed WHERE skill_len > 1) WHERE token <> '' GROUP BY 1")
def _(s, d):
    return dictionary.token_counts(table(s, d, "skills_processed").filter("skill_len > 1"), "skill_stemmed")


@query("unique_token", """WITH e AS (SELECT skill_id, unnest(string_split(skill_cleaned,' ')) AS token, generate_subscripts(string_split(skill_cleaned,' '),1) AS pos FROM skills_processed), o AS (SELECT token FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT skill_id, arg_min(token, pos) AS unique_token FROM e JOIN o USING (token) GROUP BY 1""")
def _(s, d):
    return dictionary.unique_tokens(table(s, d, "skills_processed"))


@query("surface_forms", f"WITH {sql.PATTERNS} SELECT skill_id, high, array_to_string(low, '|') AS low, match_on_tokens FROM forms")
def _(s, d):
    f = dictionary.surface_forms(table(s, d, "skills_processed"))
    return f.select("skill_id", "high", F.array_join("low", "|").alias("low"), "match_on_tokens")


@query("skill_processing")
def _(s, d):
    return dictionary.processed(table(s, d, "skills_processed").select("skill_id", "skill_name", "skill_type"))


@query("match_patterns", f"WITH {sql.PATTERNS} SELECT skill_id, source, form, case_sensitive FROM patterns")
def _(s, d):
    return dictionary.match_patterns(dictionary.surface_forms(table(s, d, "skills_processed")))


@query("type_counts", "SELECT skill_type, count(*) AS n, count(*) FILTER (skill_len = 1) AS n_single, count(*) FILTER (contains(lower(skill_name),'certif')) AS n_certificates FROM skills_processed GROUP BY 1")
def _(s, d):
    return dictionary.type_counts(table(s, d, "skills_processed"))


@query("corpus_stats", "SELECT count(*) AS n_rows, count(DISTINCT jd_id) AS n_jd, count(DISTINCT cv_id) AS n_cv, count(DISTINCT job_description_text) AS n_jd_text, count(DISTINCT resume_text) AS n_cv_text FROM dataset_train")
def _(s, d):
    c = F.countDistinct
    return table(s, d, "dataset_train").agg(F.count("*").alias("n_rows"), c("jd_id").alias("n_jd"), c("cv_id").alias("n_cv"), c("job_description_text").alias("n_jd_text"), c("resume_text").alias("n_cv_text"))


@query("ngram_mining", r"""WITH t AS (SELECT regexp_extract_all(lower(summary),'[a-zA-ZÀ-ỹ0-9+#.\-]{2,}') AS t FROM cv WHERE summary IS NOT NULL),
g AS (SELECT array_to_string(t[i:i+n-1],' ') AS phrase FROM (SELECT t, n, unnest(range(1, len(t)-n+2)) AS i FROM t, range(1,5) r(n)))
SELECT phrase, count(*) AS freq FROM g WHERE len(phrase) > 2 AND phrase NOT IN ('c','r','go','net','ai','ml') AND NOT regexp_matches(phrase,'^[0-9.]+$') AND phrase NOT IN (SELECT lower(alias) FROM skill_alias UNION ALL SELECT lower(skill_name) FROM skills_processed) GROUP BY 1 HAVING count(*) >= 3""")
def _(s, d):
    known = table(s, d, "skill_alias").select("alias").unionByName(table(s, d, "skills_processed").select(F.col("skill_name").alias("alias")))
    return skills.mine_phrases(spread(table(s, d, "cv").select(F.col("summary").alias("text"))), known)


@query("alias_updates")
def _(s, d):
    """Mined phrases with their nearest skill by hashed vectors; the accepted ones as a change log."""
    from skillweave.operators.features import HashedEmbedder, embed
    from skillweave.operators.knn import nearest

    e = HashedEmbedder(128)
    mined = Q["ngram_mining"](s, d)
    vec = lambda df, idc: df.join(embed(df.select("text"), e), F.sha1(F.concat(F.lit(e.name + "|"), text.norm_text("text"))) == F.col("key")).select(idc, "vec")
    items = vec(mined.select(F.xxhash64("phrase").alias("query_id"), F.col("phrase").alias("text")), "query_id")
    sk = table(s, d, "skills_processed").select(F.xxhash64("skill_id").alias("entry_id"), "skill_id", F.col("skill_name").alias("text"))
    best = nearest(items, vec(sk, "entry_id"), 0.9).withColumnRenamed("score", "similarity")
    j = best.join(mined.withColumn("query_id", F.xxhash64("phrase")), "query_id").join(sk.select("entry_id", "skill_id"), "entry_id")
    return dictionary.accept_aliases(j.select(F.col("phrase").alias("alias"), "skill_id", "similarity", "freq"))


_PARTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(summary,''),'\r?\n|\\n'), lambda p: " + sql.collapse("p") + "), lambda p: len(p) >= 2)"


@query("esco_labels", f"SELECT rev_id, len(u) AS n_parts, coalesce(u[1],'') AS first_label, array_to_string(u, '|') AS labels FROM (SELECT rev_id, list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i) AS u FROM (SELECT rev_id, {_PARTS} AS p FROM cv))")
def _(s, d):
    t = table(s, d, "cv").select("rev_id", text.label_parts("summary").alias("p"))
    return t.select("rev_id", F.size("p").cast("long").alias("n_parts"), F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("first_label"), F.array_join("p", "|").alias("labels"))


@query("dict_merge", """WITH r AS (SELECT skill_name AS canonical, 0 AS src, 0 AS pos, skill_name AS alias FROM skills_processed UNION ALL SELECT skill_name, 0, 1, abbreviation FROM skills_processed WHERE abbreviation <> ''
UNION ALL SELECT skill_name, 1, 0, alias FROM skill_alias JOIN skills_processed USING (skill_id)), u AS (SELECT canonical, lower(alias) AS k, min(src) AS src FROM r GROUP BY 1, 2) SELECT canonical, count(*) AS n_aliases, count(*) FILTER (src = 1) AS n_added FROM u GROUP BY 1""")
def _(s, d):
    sp, al = table(s, d, "skills_processed"), table(s, d, "skill_alias")
    base = sp.select(F.col("skill_name").alias("canonical"), F.when(F.col("abbreviation") != "", F.array("skill_name", "abbreviation")).otherwise(F.array("skill_name")).alias("aliases"))
    extra = al.join(sp.select("skill_id", "skill_name"), "skill_id").groupBy(F.col("skill_name").alias("canonical")).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    m = skills.merge_dictionaries(base, extra)
    return m.join(base.withColumnRenamed("aliases", "b"), "canonical").select("canonical", F.size("aliases").cast("long").alias("n_aliases"), (F.size("aliases") - F.size("b")).cast("long").alias("n_added"))
