"""Pieces of SQL shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from skillweave.functions.text import SPELLINGS, STOP_WORDS

SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
STOPS = "(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x},''),'{SPACE}',' ','g'))"


def clean(x: str) -> str:
    s = f"coalesce({x},'')"
    for pattern in (r"<[^>]+>", r"(?i)https?://\S+|www\.\S+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"):
        s = f"regexp_replace({s},'{pattern}',' ','g')"
    s = f"lower({collapse(s)})"
    for pattern, to in SPELLINGS:
        s = f"regexp_replace({s},'{pattern}','{to}','g')"
    return s


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all({clean(x)},'[a-z0-9][a-z0-9+._/#-]*'), lambda t: t NOT IN {STOPS})"


PAIRS = "SELECT row_id, lower(trim(jd_id)) AS grp, job_description_text AS jd_text, resume_text, label, cv_id FROM dataset_train WHERE jd_id IS NOT NULL"
TOKS = f"toks AS (SELECT grp, row_id, {tokens('resume_text')} AS toks FROM pairs)"
JD = f"jd AS (SELECT grp, arg_min(coalesce(jd_text,''), row_id) AS jd_text FROM pairs GROUP BY grp), q AS (SELECT grp, term, count(*) AS qtf FROM (SELECT grp, unnest({tokens('jd_text')}) AS term FROM jd) GROUP BY 1, 2)"


def bm25(docs: str, query: str, out: str) -> str:
    """CTEs that end in ``out`` (grp, row_id, score) of docs (grp, row_id, toks) and query (grp, term, qtf)."""
    return f"""{out}_e AS (SELECT grp, row_id, unnest(toks) AS term FROM {docs}),
{out}_n AS (SELECT grp, count(*) AS n, avg(len(toks)) AS avgdl FROM {docs} GROUP BY 1),
{out}_df AS (SELECT grp, term, count(DISTINCT row_id) AS df FROM {out}_e GROUP BY 1, 2),
{out}_i0 AS (SELECT grp, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM {out}_df JOIN {out}_n USING (grp)),
{out}_m AS (SELECT grp, avg(idf0) AS avg_idf FROM {out}_i0 GROUP BY 1),
{out}_i AS (SELECT grp, term, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25 * avg_idf END AS idf FROM {out}_i0 JOIN {out}_m USING (grp)),
{out}_tf AS (SELECT grp, row_id, term, count(*) AS tf FROM {out}_e GROUP BY 1, 2, 3),
{out}_s AS (SELECT t.grp, t.row_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.toks) / avgdl))) AS score
  FROM {out}_tf t JOIN {query} q ON q.grp = t.grp AND q.term = t.term JOIN {out}_i i ON i.grp = t.grp AND i.term = t.term
  JOIN {docs} d ON d.grp = t.grp AND d.row_id = t.row_id JOIN {out}_n n ON n.grp = t.grp GROUP BY 1, 2),
{out} AS (SELECT d.grp, d.row_id, coalesce(score, 0) AS score FROM {docs} d LEFT JOIN {out}_s s ON s.grp = d.grp AND s.row_id = d.row_id)"""


#: The surface forms and patterns of the skill list: ends in forms (skill_id, high, low, match_on_tokens) and patterns.
PATTERNS = r"""f0 AS (SELECT *, string_split(skill_stemmed, ' ') AS st, regexp_replace(skill_name, '[(\[].*?[)\]]', '', 'g') AS bare FROM skills_processed), fm AS (SELECT token, count(*) AS n FROM (SELECT unnest(st) AS token FROM f0 WHERE skill_len > 1) WHERE token <> '' GROUP BY 1),
f1 AS (SELECT f0.*, st[1] AS a, st[-1] AS z, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nz FROM f0 LEFT JOIN fm x ON x.token = st[1] LEFT JOIN fm y ON y.token = st[-1]),
f2 AS (SELECT *, list_concat(CASE WHEN skill_len = 2 AND nz = 1 THEN [z] ELSE [] END, CASE WHEN skill_len = 2 AND nz > 0 AND na / greatest(nz, 1) < 0.2 THEN [a] ELSE [] END) AS uni FROM f1), fu AS (SELECT list(u) AS us FROM (SELECT u FROM (SELECT unnest(uni) AS u FROM f2) GROUP BY 1 HAVING count(*) = 1)),
fs AS (SELECT skill_id, skill_len, list_concat(regexp_extract_all(bare, '\b[A-Z]{2,}\b'), regexp_extract_all(bare, '\b[A-Z](?:&[A-Z])+\b'), regexp_extract_all(bare, '\b[A-Z](?:\.[A-Z])+\b')) AS acrs FROM f0 WHERE skill_len > 1),
fa AS (SELECT list(acr) AS sole FROM (SELECT acr FROM (SELECT unnest(acrs) AS acr FROM fs) GROUP BY 1 HAVING count(*) = 1)),
forms AS (SELECT skill_id, CASE WHEN f2.skill_len = 1 THEN skill_cleaned WHEN f2.skill_len > 1 THEN skill_lemmed END AS high, CASE WHEN f2.skill_len = 1 AND match_on_stemmed THEN [skill_stemmed]
WHEN f2.skill_len = 2 THEN list_concat([skill_stemmed, z || ' ' || a], list_filter(uni, lambda x: list_contains(us, x))) WHEN f2.skill_len > 2 THEN coalesce(list_sort(list_filter(acrs, lambda x: list_contains(sole, x))), []) ELSE [] END AS low, f2.skill_len > 2 AS match_on_tokens FROM f2 LEFT JOIN fs USING (skill_id), fu, fa),
lows AS (SELECT skill_id, form, regexp_matches(form, '^[A-Z&.]{2,}$') AND (len(form) > 2 OR form IN ('SQL', 'NLP', 'AI', 'ML')) AS up FROM (SELECT skill_id, unnest(low) AS form FROM forms) WHERE form <> ''),
patterns AS (SELECT skill_id, 'high' AS source, high AS form, false AS case_sensitive FROM forms WHERE high <> '' UNION SELECT skill_id, CASE WHEN up THEN 'acronym' ELSE 'low' END, form, up FROM lows)"""

#: Words of the texts with their offsets: wd (doc_id, k, word, low, s, e), docs_w (doc_id, n_words).
WORDS = r"""rn AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS r FROM documents WHERE text IS NOT NULL)),
ro AS (SELECT doc_id, run, i, sum(len(run)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM rn), wd AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, run AS word, lower(run) AS low, CAST(e - len(run) AS INT) AS s, CAST(e AS INT) AS e FROM ro WHERE regexp_matches(run, '^[\p{L}\p{N}]')),
docs_w AS (SELECT doc_id, count(*) AS n_words FROM wd GROUP BY 1)"""

#: Phrase hits of all tiers: th (doc_id, start, end, skill_id, source, match, score).
TIERS = r"""pn AS (SELECT *, lower(form) AS key, len(string_split(form, ' ')) AS n FROM patterns), cd AS (SELECT doc_id, k, n, key, form, case_sensitive, skill_id, source, unnest(range(0, n)) AS o FROM wd JOIN (SELECT *, string_split(key, ' ')[1] AS head FROM pn) ON low = head),
ti AS (SELECT DISTINCT doc_id, s, e, skill_id, source FROM (SELECT min(x.s) AS s, max(x.e) AS e, cd.doc_id, cd.k, n, key, form, case_sensitive, skill_id, source, string_agg(x.low, ' ' ORDER BY x.k) AS lows, string_agg(x.word, ' ' ORDER BY x.k) AS gram FROM cd JOIN wd x ON x.doc_id = cd.doc_id AND x.k = cd.k + cd.o GROUP BY ALL)
WHERE lows = key AND (NOT case_sensitive OR gram = form)),
th AS (SELECT ti.doc_id, s AS start, e AS "end", skill_id, ti.source, substring(text, s + 1, e - s) AS match, 1.0::DOUBLE AS score FROM ti JOIN documents d ON d.doc_id = ti.doc_id)"""

#: Occurrences of the words of token forms: oc (doc_id, skill_id, k, low, n, nd) with n words of which nd are different.
TOKENS = r"""tf AS (SELECT skill_id, string_split(high, ' ') AS toks FROM forms WHERE match_on_tokens), tw AS (SELECT skill_id, len(toks) AS n, len(list_distinct(toks)) AS nd, unnest(list_distinct(toks)) AS low FROM tf), oc AS (SELECT doc_id, skill_id, k, low, n, nd FROM wd JOIN tw USING (low))"""

#: Token windows: kh, as th.
TOKEN_WINDOW = r"""ok AS (SELECT *, CAST(ceil(0.8::DOUBLE * n) AS INT) AS need, n + CAST(floor(0.2::DOUBLE * n) AS INT) AS win FROM oc WHERE n >= 3),
kc AS (SELECT DISTINCT doc_id, skill_id, need, win, unnest(range(greatest(0, k - win + 1), k + 1)) AS i FROM ok), kw AS (SELECT c.doc_id, c.skill_id, c.i, c.win FROM kc c JOIN ok USING (doc_id, skill_id) WHERE ok.k BETWEEN c.i AND c.i + c.win - 1 GROUP BY c.doc_id, c.skill_id, c.i, c.win, c.need HAVING count(DISTINCT low) >= c.need),
kh AS (SELECT kw.doc_id, a.s AS start, b.e AS "end", skill_id, 'token' AS source, substring(text, a.s + 1, b.e - a.s) AS match, 1.0::DOUBLE AS score FROM kw JOIN docs_w n ON n.doc_id = kw.doc_id AND i < n_words - 1 JOIN documents d ON d.doc_id = kw.doc_id JOIN wd a ON a.doc_id = kw.doc_id AND a.k = i JOIN wd b ON b.doc_id = kw.doc_id AND b.k = least(n_words, i + win) - 1)"""

TOKEN_WINDOW_ALL = r"""ak AS (SELECT *, nd + CAST(ceil(nd * 0.2::DOUBLE) AS INT) AS win FROM oc WHERE nd > 2), ac AS (SELECT DISTINCT doc_id, skill_id, nd, win, unnest(range(greatest(0, k - win + 1), k + 1)) AS i FROM ak),
af AS (SELECT c.doc_id, c.skill_id, c.i, c.nd, low, min(k) AS k FROM ac c JOIN ak USING (doc_id, skill_id) WHERE ak.k BETWEEN c.i AND c.i + c.win - 1 GROUP BY ALL), aw AS (SELECT doc_id, skill_id, i, min(k) AS lo, max(k) AS hi FROM af GROUP BY doc_id, skill_id, i, nd HAVING count(*) = nd),
ah AS (SELECT aw.doc_id, a.s AS start, b.e AS "end", skill_id, 'token' AS source, substring(text, a.s + 1, b.e - a.s) AS match FROM aw JOIN documents d ON d.doc_id = aw.doc_id JOIN docs_w n ON n.doc_id = aw.doc_id AND i < n_words - aw_nd(skill_id) + 1 JOIN wd a ON a.doc_id = aw.doc_id AND a.k = lo JOIN wd b ON b.doc_id = aw.doc_id AND b.k = hi)"""
TOKEN_WINDOW_ALL = TOKEN_WINDOW_ALL.replace("SELECT doc_id, skill_id, i, min(k) AS lo", "SELECT doc_id, skill_id, i, nd, min(k) AS lo").replace("aw_nd(skill_id)", "nd")


def resolved(hits: str, by: str) -> str:
    """CTEs that end in rs, the greedy choice of non-overlapping spans of ``hits`` per text."""
    if by == "source":
        order = "CASE source WHEN 'high' THEN 3 WHEN 'acronym' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, e - s DESC, s, score DESC, skill_id"
    else:
        order = "s, e - s DESC, CASE source WHEN 'high' THEN 4 WHEN 'acronym' THEN 3 WHEN 'semantic' THEN 3 WHEN 'low' THEN 2 ELSE 1 END DESC, score DESC, skill_id"
    return f"""rh AS (SELECT DISTINCT doc_id, start AS s, "end" AS e, skill_id, source, match, score FROM ({hits})), rl AS (SELECT doc_id, list([{{'s': s, 'e': e, 'skill_id': skill_id, 'source': source, 'match': match}}] ORDER BY {order}) AS l FROM rh GROUP BY 1),
rp AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda c: c.s < x[1].e AND x[1].s < c.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM rl), rs AS (SELECT doc_id, x.s AS start, x.e AS "end", x.skill_id AS skill_id, x.source AS source, x.match AS match FROM rp)"""
