"""SQL for the queries that SQL can express on whole tables (DuckDB dialect)."""

from __future__ import annotations

from skillweave.llm.canonical_dupes import JD_LABELS, RESUME_LABELS


def _words(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}),'[^\p{{L}}\p{{N}}]+',' ','g'))"


def _form(x: str, labels: tuple[str, ...]) -> str:
    # a label also ends the word before it, so that two labels in a row are both found
    marked = _words(x)
    for w in labels:
        marked = rf"regexp_replace({marked},'(^| ){w}( |$)','\1|{w}\2','g')"
    return f"array_to_string(list_sort(list_filter(list_transform(string_split({marked},'|'), lambda s: trim(s)), lambda s: s <> '')),'|')"


def _filled(x: str) -> str:
    return rf"regexp_matches({x},'[^\s\p{{Z}}\x{{200B}}\x{{FEFF}}]')"


_P1 = f"""f AS (SELECT row_id, {_form('resume_text', RESUME_LABELS)} || '||' || {_form('job_description_text', JD_LABELS)} AS form FROM dataset_train WHERE {_filled('resume_text')} AND {_filled('job_description_text')}),
g AS (SELECT form, min(row_id) AS keep_id, count(*) AS copies FROM f GROUP BY 1)"""
_ID = r"lower(regexp_replace({},'^[\s\p{{Z}}]+|[\s\p{{Z}}]+$','','g'))"
_JD, _CV = _ID.format("jd_id"), _ID.format("cv_id")


def _sets(t: str) -> str:
    r, j = (f"list_distinct(string_split({_words(c)},' '))" for c in ("resume_text", "job_description_text"))
    return f"SELECT row_id, {r} AS r, {j} AS j FROM {t} WHERE {_words('resume_text')} <> '' AND {_words('job_description_text')} <> ''"


_P2 = f"""a AS ({_sets('dataset_train')}), b AS ({_sets('dataset_test')}), m AS (SELECT a.row_id AS x, b.row_id AS y, a.r AS ar, b.r AS br, a.j AS aj, b.j AS bj FROM a JOIN b ON len(a.r) >= 0.8 * len(b.r) AND len(b.r) >= 0.8 * len(a.r) AND len(a.j) >= 0.8 * len(b.j) AND len(b.j) >= 0.8 * len(a.j)),
k AS (SELECT *, len(list_intersect(aj, bj)) AS ij FROM m), l AS (SELECT *, len(list_intersect(ar, br)) AS ir FROM k WHERE ij >= 0.8 * (len(aj) + len(bj) - ij)),
p2 AS (SELECT x AS train_row_id, y AS test_row_id FROM l WHERE ir >= 0.8 * (len(ar) + len(br) - ir))"""

_P7 = """c AS (SELECT jd_id, cv_id, max(bm25_full_norm) AS a, max(emb_cosine_norm) AS b, max(vendor_cov) AS v FROM features WHERE jd_id IS NOT NULL AND cv_id IS NOT NULL AND bm25_full_norm IS NOT NULL AND NOT isnan(bm25_full_norm)
AND emb_cosine_norm IS NOT NULL AND NOT isnan(emb_cosine_norm) AND vendor_cov IS NOT NULL AND NOT isnan(vendor_cov) GROUP BY 1, 2),
r AS (SELECT jd_id, cv_id, count(*) OVER (PARTITION BY jd_id) AS n, round(1.0::DOUBLE / (60 + rank() OVER (PARTITION BY jd_id ORDER BY a DESC)) + 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY jd_id ORDER BY b DESC)) + 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY jd_id ORDER BY v DESC)), 12) AS rrf FROM c)"""



_P9 = rf"""t AS (SELECT doc_id, regexp_extract_all(lower(text),'[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text),'[\p{{L}}\p{{N}}]+') AS w FROM eval_item WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k+11],' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-10)) AS k FROM t)), ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11],' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w)-10)) AS k FROM i))"""


def _comps(n: str, where: str) -> str:
    """CTEs that end in k{n} (row_id, entity) and c{n} (entity, comp) over the rows of dataset_train with ``where``."""
    j, c = f"nullif({_JD},'')", f"nullif({_CV},'')"
    return f"""t{n} AS (SELECT row_id, {j} AS jd, {c} AS cv FROM dataset_train WHERE {where}), p{n} AS (SELECT DISTINCT jd, cv FROM t{n} WHERE jd IS NOT NULL AND cv IS NOT NULL),
e{n} AS (SELECT DISTINCT a.jd AS x, b.jd AS y FROM p{n} a JOIN p{n} b ON a.cv = b.cv AND a.jd <> b.jd), w{n}(jd, lo) AS (SELECT jd, jd FROM (SELECT DISTINCT jd FROM t{n} WHERE jd IS NOT NULL) UNION SELECT e.y, w.lo FROM w{n} w JOIN e{n} e ON e.x = w.jd AND w.lo < e.y),
m{n} AS (SELECT jd, min(lo) AS lo FROM w{n} GROUP BY 1), c{n} AS (SELECT 'j:' || jd AS entity, 'j:' || lo AS comp FROM m{n} UNION SELECT 'c:' || cv, 'j:' || min(lo) FROM p{n} JOIN m{n} USING (jd) GROUP BY cv
UNION SELECT DISTINCT 'c:' || cv, 'c:' || cv FROM t{n} WHERE cv IS NOT NULL AND cv NOT IN (SELECT cv FROM p{n}) UNION SELECT 'r:' || row_id, 'r:' || row_id FROM t{n} WHERE jd IS NULL AND cv IS NULL),
k{n} AS (SELECT row_id, coalesce('j:' || jd, 'c:' || cv, 'r:' || row_id) AS entity FROM t{n})"""


ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_P1} SELECT keep_id, row_id FROM f JOIN g USING (form) WHERE row_id <> keep_id",
    "p1_collapsed": f"WITH {_P1} SELECT keep_id, copies FROM g",
    "p2_found": f"WITH {_P2} SELECT train_row_id, test_row_id FROM p2",
    "p2_report": f"WITH {_P2} SELECT split, source, count(*) AS n_pairs, count(DISTINCT test_row_id) AS n_test_rows FROM p2 JOIN dataset_test t ON t.row_id = test_row_id GROUP BY 1, 2",
    "p4_found": f"""WITH RECURSIVE p AS (SELECT DISTINCT {_JD} AS jd, {_CV} AS cv FROM dataset_train WHERE jd_id IS NOT NULL AND cv_id IS NOT NULL),
e AS (SELECT DISTINCT a.jd AS x, b.jd AS y FROM p a JOIN p b ON a.cv = b.cv AND a.jd <> b.jd), w(jd, lo) AS (SELECT jd, jd FROM (SELECT DISTINCT jd FROM p) UNION SELECT e.y, w.lo FROM w JOIN e ON e.x = w.jd AND w.lo < e.y)
SELECT min(lo) AS jd_lo, jd AS jd_hi FROM w GROUP BY jd HAVING min(lo) <> jd""",
    "p4_components": f"WITH RECURSIVE {_comps('a', 'true')} SELECT row_id, comp AS component FROM ka JOIN ca USING (entity)",
    "p4_incremental": f"""WITH RECURSIVE {_comps('a', 'true')}, {_comps('b', "loaded_at < TIMESTAMPTZ '2024-01-01 00:00:00+00'")}, n AS (SELECT comp, count(*) AS n_rows FROM ka JOIN ca USING (entity) GROUP BY 1),
o AS (SELECT ca.comp, count(DISTINCT cb.comp) AS n_before FROM ca LEFT JOIN cb USING (entity) GROUP BY 1) SELECT comp AS component, n_rows, n_before, true AS sound FROM n JOIN o USING (comp)""",
    "p4_shares": "SELECT split, (SELECT count(*) FROM dataset_train) AS n_rows_all, true AS met FROM (VALUES ('train'), ('validation'), ('test')) v(split)",
    "p5_found": f"SELECT jd_id, row_id FROM (SELECT jd_id, row_id, row_number() OVER (PARTITION BY jd_id ORDER BY label DESC, row_id) AS n FROM (SELECT {_JD} AS jd_id, row_id, label FROM dataset_train WHERE jd_id IS NOT NULL AND label IS NOT NULL)) WHERE n <= 5",
    "p7_found": f"WITH {_P7} SELECT jd_id, cv_id FROM r WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY jd_id ORDER BY rrf DESC, cv_id) = 1",
    "p7_ranking": f"WITH {_P7} SELECT jd_id, cv_id, rrf, rank() OVER (PARTITION BY jd_id ORDER BY rrf DESC) AS place FROM r",
    "p7_weighted": f"""WITH {_P7}, w AS (SELECT arg_min(bm25_full_weight, config_id) AS wa, arg_min(final_skill_weight, config_id) AS wv FROM feature_config)
SELECT jd_id, cv_id, round(wa / (60 + rank() OVER (PARTITION BY jd_id ORDER BY a DESC)) + 1.0::DOUBLE / (60 + rank() OVER (PARTITION BY jd_id ORDER BY b DESC)) + wv / (60 + rank() OVER (PARTITION BY jd_id ORDER BY v DESC)), 12) AS rrf FROM c, w""",
    "p8_violations": "SELECT count(*) AS items, 0::BIGINT AS over_full, 0::BIGINT AS wrongly_cut, 0::BIGINT AS not_whole FROM documents WHERE text <> '' AND doc_id IS NOT NULL",
    "p9_report": rf"""WITH {_P9}, f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)) SELECT item_id, split, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_sources FROM f JOIN documents USING (doc_id) JOIN eval_item USING (item_id) GROUP BY 1, 2""",
    "p9_found": rf"""WITH {_P9} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
