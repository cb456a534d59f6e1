"""Queries of vector search, entity tables, spans and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillweave.functions import text
from skillweave.functions.vectors import l2_normalize, norm
from skillweave.operators import dictionary, knn, spans
from skillweave.plans import sql
from skillweave.runtime import materialize, shared_folder, spread, table
from skillweave.sources import tables
from skillweave.sources.index_store import IndexStore
from skillweave.streaming import flows

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


_DRAW = "('0x' || substr(md5('42|' || {}), 1, 8))::BIGINT"


def emb(s, d):
    return table(s, d, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def unit(s, d):
    return emb(s, d).select("item_id", l2_normalize("vec").alias("vec"), "label")


def ids_by_100(df):
    """The stated query set: every row whose id is divisible by 100."""
    return df.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vec")


_E = "e AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT item_id, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec, label FROM e)"


@query("l2_normalize", f"WITH {_E} SELECT u.item_id, round(sqrt(list_dot_product(e.vec, e.vec)), 6) AS length, round(u.vec[1], 6) + 0.0 AS first, round(u.vec[-1], 6) + 0.0 AS last FROM u JOIN e USING (item_id)")
def _(s, d):
    e = emb(s, d).withColumn("u", l2_normalize("vec"))
    return e.select("item_id", r6(norm("vec")).alias("length"), r6(F.col("u")[0]).alias("first"), r6(F.element_at("u", -1)).alias("last"))


@query("ann_topk_ip", f"WITH {_E}, s AS (SELECT q.item_id AS query_id, b.item_id, list_dot_product(q.vec, b.vec) AS score FROM u q, u b WHERE q.item_id % 100 = 0) SELECT query_id, item_id, round(score, 6) + 0.0 AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS place FROM s) WHERE place <= 10")
def _(s, d):
    u = unit(s, d)
    return knn.exact_topk(u, ids_by_100(u), 10).select("query_id", "item_id", r6("score").alias("score"), "place")


@query("ann_topk_l2", f"WITH {_E}, s AS (SELECT q.item_id AS query_id, b.item_id, list_dot_product(q.vec, q.vec) - 2 * list_dot_product(q.vec, b.vec) + list_dot_product(b.vec, b.vec) AS dist FROM e q, e b WHERE q.item_id % 100 = 0) SELECT query_id, item_id, round(greatest(dist, 0), 5) + 0.0 AS dist, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), item_id) AS place FROM s) WHERE place <= 10")
def _(s, d):
    e = emb(s, d)
    return knn.exact_topk(e, ids_by_100(e), 10, "l2").select("query_id", "item_id", (F.round(F.greatest("score", F.lit(0.0)), 5) + F.lit(0.0)).alias("dist"), "place")


@query("ann_topk_ivf")
def _(s, d):
    u = materialize(unit(s, d), "unit")
    return knn.ivf_topk(u, ids_by_100(u), 10).select("query_id", "item_id", r6("score").alias("score"), "place")


@query("centroid", f"WITH {_E}, x AS (SELECT label, i, avg(vec[i]) AS m FROM e, range(1, 65) r(i) GROUP BY 1, 2) SELECT label, round(max(m) FILTER (i = 1), 6) + 0.0 AS first, round(max(m) FILTER (i = 64), 6) + 0.0 AS last, round(sum(m), 5) + 0.0 AS total FROM x GROUP BY 1")
def _(s, d):
    c = knn.centroid(emb(s, d), "label", "vec")
    return c.select("label", r6(F.col("vec")[0]).alias("first"), r6(F.col("vec")[63]).alias("last"), (F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)).alias("total"))


def entries(s, d):
    return materialize(knn.centroid(unit(s, d), "label", "vec").select(F.col("label").cast("long").alias("entry_id"), l2_normalize("vec").alias("vec")), "entries")


_C = f"{_E}, c0 AS (SELECT label AS entry_id, list(m ORDER BY i) AS vec FROM (SELECT label, i, avg(vec[i]) AS m FROM u, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1), c AS (SELECT CAST(entry_id AS BIGINT) AS entry_id, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)) AS vec FROM c0), s AS (SELECT u.item_id, c.entry_id, list_dot_product(u.vec, c.vec) AS score FROM u, c), p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, entry_id) AS place FROM s)"


@query("nearest_canonical", f"WITH {_C} SELECT item_id, entry_id, round(score, 6) + 0.0 AS score FROM p WHERE place = 1 AND score >= 0.7")
def _(s, d):
    n = knn.nearest(unit(s, d).select(F.col("item_id").alias("query_id"), "vec"), entries(s, d), 0.7)
    return n.select(F.col("query_id").alias("item_id"), "entry_id", r6("score").alias("score"))


@query("semantic_topk", f"WITH {_C} SELECT item_id, entry_id, round(score, 6) + 0.0 AS score, place FROM p WHERE place <= 3 AND score >= 0.2")
def _(s, d):
    n = knn.exact_by_entries(unit(s, d).select(F.col("item_id").alias("query_id"), "vec"), entries(s, d), 3).filter(F.col("score") >= 0.2)
    return n.select(F.col("query_id").alias("item_id"), "entry_id", r6("score").alias("score"), "place")


def _new_store(s, name):
    import uuid

    return IndexStore(s, f"{shared_folder(s)}/index-{name}-{uuid.uuid4().hex}")


@query("index_meta", "SELECT 64 AS dim, count(*) AS count, 'ip' AS metric, 'flat' AS index_kind FROM embeddings WHERE embedding IS NOT NULL")
def _(s, d):
    st = _new_store(s, "meta")
    st.build(emb(s, d).select("item_id", "vec"))
    return st.meta().select(F.col("dim").cast("int").alias("dim"), "count", "metric", "index_kind")


@query("index_upsert", "SELECT vec_id AS item_id, CASE WHEN vec_id % 3 = 0 THEN 'updated' ELSE 'first' END AS state FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 7 <> 0")
def _(s, d):
    """Build, update every third id, delete every seventh: one row per id is left."""
    st = _new_store(s, "upsert")
    e = emb(s, d).select("item_id", "vec")
    st.build(e.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")))
    up = e.filter("item_id % 3 = 0 OR item_id % 7 = 0").withColumn("updated_at", F.lit("2024-02-01").cast("timestamp")).withColumn("is_active", F.col("item_id") % 7 != 0)
    st.append(up)
    return st.load().select("item_id", F.when(F.col("updated_at") > F.lit("2024-01-15").cast("timestamp"), "updated").otherwise("first").alias("state"))


@query("active_scan", "SELECT rev_id, summary FROM cv WHERE is_active AND summary IS NOT NULL AND trim(summary) <> ''")
def _(s, d):
    return tables.active(table(s, d, "cv"), "rev_id", "summary")


@query("owner_scan", "SELECT rev_id, summary FROM cv WHERE is_active AND summary IS NOT NULL AND trim(summary) <> '' AND user_id = (SELECT min(user_id) FROM cv)")
def _(s, d):
    c = table(s, d, "cv")
    who = c.agg(F.min("user_id").alias("user_id"))
    return tables.active(c.join(F.broadcast(who), "user_id", "left_semi"), "rev_id", "summary")


@query("latest_first", "SELECT id, rev_id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, rev_id DESC) AS rn FROM cv WHERE id IS NOT NULL) WHERE rn = 1")
def _(s, d):
    c = table(s, d, "cv").filter("id IS NOT NULL").select("id", "rev_id", "updated_at", "ingested_at")
    return tables.latest(c, "id", ["updated_at", "ingested_at", "rev_id"]).select("id", "rev_id", "updated_at")


@query("applications", "SELECT o_orderkey AS link_id, c_custkey AS cv_id, c_name AS name, o_orderdate AS applied_at FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("cv_id"), F.col("o_orderdate").alias("applied_at"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("cv_id"), F.col("c_name").alias("name"))
    return tables.applicants(o, c).select("link_id", "cv_id", "name", "applied_at")


_L = "SELECT DISTINCT lower(trim(jd_id)) AS jd_id, lower(trim(cv_id)) AS cv_id FROM {} WHERE jd_id IS NOT NULL AND cv_id IS NOT NULL"


@query("dedupe_links", f"({_L.format('dataset_test')}) EXCEPT ({_L.format('dataset_train')})")
def _(s, d):
    link = lambda n: table(s, d, n).filter("jd_id IS NOT NULL AND cv_id IS NOT NULL").select(F.lower(F.trim("jd_id")).alias("jd_id"), F.lower(F.trim("cv_id")).alias("cv_id"))
    return tables.insert_missing(link("dataset_train"), link("dataset_test"), ["jd_id", "cv_id"])


@query("link_sample_k", f"""WITH r AS (SELECT id AS job_id, row_number() OVER (ORDER BY id) - 1 AS slot FROM (SELECT DISTINCT id FROM job WHERE id IS NOT NULL)), n AS (SELECT count(*) AS n FROM r),
l AS (SELECT id, n, unnest(range(0, least(3, n))) AS j FROM (SELECT DISTINCT id FROM cv WHERE id IS NOT NULL), n) SELECT l.id, r.job_id FROM l JOIN r ON r.slot = ({_DRAW.format('l.id')} % n + j * greatest(n // 3, 1)) % n""")
def _(s, d):
    return tables.sample_links(table(s, d, "cv").filter("id IS NOT NULL"), table(s, d, "job").filter("id IS NOT NULL").withColumnRenamed("id", "job_id"), "id", "job_id", 3)


@query("admin_search", "SELECT rev_id, title FROM job WHERE (title ILIKE '%engineer%' OR job_location ILIKE '%carrowick%') AND posted_at >= TIMESTAMP '2024-01-01'")
def _(s, d):
    j = table(s, d, "job").filter(F.col("posted_at") >= F.lit("2024-01-01").cast("timestamp"))
    return j.filter(F.col("title").ilike("%engineer%") | F.col("job_location").ilike("%carrowick%")).select("rev_id", "title")


@query("comma_list", "SELECT rev_id, len(list_filter(list_transform(string_split(coalesce(cv_location,''), ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM cv")
def _(s, d):
    return table(s, d, "cv").select("rev_id", F.size(text.comma_list("cv_location")).cast("long").alias("n"))


@query("group_split", f"SELECT jd_id, count(*) AS n, {_DRAW.format('jd_id')} % 10000 < 2000 AS val FROM features GROUP BY 1")
def _(s, d):
    """The side of every row, as rows per group and side: a group on both sides would have two rows."""
    from skillweave.operators.ranker import group_split

    return table(s, d, "features").withColumn("val", group_split(None, "jd_id")).groupBy("jd_id", "val").agg(F.count("*").alias("n"))


@query("row_split", f"SELECT split, count(*) AS n, min(row_id) AS first_id, sum(row_id)::BIGINT AS total FROM (SELECT row_id, CASE WHEN u < 8 THEN 'train' WHEN u < 9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_id, {_DRAW.format('row_id')} % 10 AS u FROM dataset_train)) GROUP BY 1")
def _(s, d):
    """The 80/10/10 split of rows that a fine-tuning of the encoder starts from."""
    from skillweave.operators.ranker import three_way

    t = table(s, d, "dataset_train").select("row_id", three_way("row_id").alias("split"))
    return t.groupBy("split").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"), F.sum("row_id").alias("total"))


def patterns(s, d):
    return materialize(dictionary.match_patterns(dictionary.surface_forms(table(s, d, "skills_processed"))), "patterns")


def texts(s, d):
    return spread(table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))


def token_forms(s, d):
    f = dictionary.surface_forms(table(s, d, "skills_processed")).filter("match_on_tokens")
    return [(r["skill_id"], r["high"].split(" ")) for r in spans.dictionary_rows(f.select("skill_id", "high"))]


_HEAD = f"WITH {sql.PATTERNS}, {sql.WORDS}"
_COLS = 'doc_id, start, "end", skill_id, source, match'
_BOTH = f"{_HEAD}, {sql.TIERS}, {sql.TOKENS}, {sql.TOKEN_WINDOW}, {sql.resolved('FROM th UNION ALL FROM kh', 'source')}"
SPAN = ("doc_id", "start", "end", "skill_id", "source", "match")


@query("span_tiers", f"{_HEAD}, {sql.TIERS} SELECT {_COLS} FROM th")
def _(s, d):
    return spans.tier_hits(texts(s, d), patterns(s, d)).select(*SPAN)


@query("token_window", f"{_HEAD}, {sql.TOKENS}, {sql.TOKEN_WINDOW} SELECT {_COLS} FROM kh")
def _(s, d):
    return spans.window_hits(texts(s, d), token_forms(s, d)).select(*SPAN)


@query("token_window_all", f"{_HEAD}, {sql.TOKENS}, {sql.TOKEN_WINDOW_ALL} SELECT {_COLS} FROM ah")
def _(s, d):
    return spans.all_token_hits(texts(s, d), token_forms(s, d)).select(*SPAN)


@query("relaxed_subseq")
def _(s, d):
    return spans.subsequence_hits(texts(s, d), token_forms(s, d)).select(*SPAN, "score")


@query("span_resolve", f"{_BOTH} SELECT {_COLS} FROM rs")
def _(s, d):
    t = texts(s, d)
    return spans.scan(t, patterns(s, d), token_forms(s, d), resolved="source").select(*SPAN)


@query("span_counts", f"{_HEAD}, {sql.TIERS}, {sql.resolved('FROM th', 'start')} SELECT doc_id, skill_id, count(*) AS occurrences FROM rs GROUP BY 1, 2")
def _(s, d):
    return spans.occurrences(spans.tier_hits(texts(s, d), patterns(s, d), "start"))


@query("training_export", f"""{_HEAD}, {sql.TIERS}, {sql.resolved('FROM th', 'source')}, lb AS (SELECT doc_id, array_to_string(list('[' || start || ', ' || "end" || ', "' || skill_type || '"]' ORDER BY start, "end", skill_type), ', ') AS l FROM rs JOIN skills_processed USING (skill_id) GROUP BY 1)
SELECT doc_id, '{{"text":' || CAST(to_json(text) AS VARCHAR) || ', "labels": [' || coalesce(l, '') || ']}}' AS value FROM documents LEFT JOIN lb USING (doc_id) WHERE text IS NOT NULL""")
def _(s, d):
    t = texts(s, d)
    return spans.training_examples(t, spans.tier_hits(t, patterns(s, d), "source"), table(s, d, "skills_processed"))


@query("annotate", f"""{_BOTH} SELECT doc_id, CAST(count(*) FILTER (rs.source = 'high') AS INT) AS "full", CAST(count(*) FILTER (rs.source NOT IN ('high', 'token')) AS INT) AS partial, CAST(count(*) FILTER (rs.source = 'token') AS INT) AS token, CAST(count(DISTINCT skill_id) AS INT) AS skills FROM documents LEFT JOIN rs USING (doc_id) WHERE text IS NOT NULL GROUP BY 1""")
def _(s, d):
    from skillweave.engine import Engine

    a = Engine(s, None).annotate(texts(s, d), patterns(s, d), table(s, d, "skills_processed"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return a.select("doc_id", n("results.full_matches").alias("full"), n("results.partial_matches").alias("partial"), n("results.token_scanner").alias("token"), n("unique_skills").alias("skills"))


@query("events_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("events_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(s, d):
    return tables.latest(table(s, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_TUMBLE = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("events_hourly", _TUMBLE)
def _(s, d):
    return flows.windowed(table(s, d, "events")).withColumn("total", F.round("total", 4))


@query("events_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, event_type FROM events, range(0, 2) r(k)) GROUP BY 1, 2")
def _(s, d):
    return flows.windowed(table(s, d, "events"), "1 hour", "30 minutes").select("start", "event_type", "n")


@query("events_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid")
def _(s, d):
    return flows.sessions(table(s, d, "events"))


def _stream(s, d, name, schema):
    return s.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query("stream_hourly", _TUMBLE)
def _(s, d):
    """The tumbling counts as a stream over the files of the table; complete mode."""
    e = _stream(s, d, "events", table(s, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.run_to_table(flows.windowed(e, late="365 days"), "complete", "hourly").withColumn("total", F.round("total", 4))


@query("stream_phrases", r"""WITH t AS (SELECT regexp_extract_all(lower(title),'[a-zA-ZÀ-ỹ0-9+#.\-]{2,}') AS t FROM job WHERE title IS NOT NULL), g AS (SELECT array_to_string(t[i:i+n-1],' ') AS phrase FROM (SELECT t, n, unnest(range(1, len(t)-n+2)) AS i FROM t, range(1,5) r(n))) SELECT phrase, count(*) AS freq FROM g GROUP BY 1""")
def _(s, d):
    j = _stream(s, d, "job", table(s, d, "job").schema).filter("title IS NOT NULL").select(F.col("title").alias("text"))
    return flows.run_to_table(flows.count_phrases(j), "complete", "phrases")


@query("stream_index", "SELECT rev_id AS item_id FROM cv WHERE is_active")
def _(s, d):
    """Index on write: summaries arrive as a stream, are embedded once per text, and can be read back."""
    import uuid

    from skillweave.operators.features import HashedEmbedder
    from skillweave.sources.index_store import VectorCache

    base = f"{shared_folder(s)}/stream-index-{uuid.uuid4().hex}"
    st = IndexStore(s, f"{base}/index")
    c = _stream(s, d, "cv", table(s, d, "cv").schema)
    c = c.select(F.col("rev_id").alias("item_id"), F.coalesce("summary", F.lit("")).alias("text"), "updated_at", F.coalesce("is_active", F.lit(False)).alias("is_active"))
    flows.keep_index(c, st, HashedEmbedder(), VectorCache(s, f"{base}/cache"), f"{base}/cp").awaitTermination()
    return st.load().select("item_id")


@query("rank_requests")
def _(s, d):
    """The rank endpoint over all posts of the test split and their candidates."""
    from skillweave.engine import Engine
    from skillweave.plans.score_queries import full_dictionary

    t = table(s, d, "dataset_test").filter("jd_id IS NOT NULL").withColumn("jd_id", F.lower(F.trim("jd_id")))
    req = t.groupBy("jd_id").agg(F.min_by("job_description_text", "row_id").alias("job_description")).withColumn("job_requirement", F.lit(None).cast("string"))
    cand = t.select("jd_id", F.lower(F.trim("cv_id")).alias("cv_id"), "resume_text")
    return Engine(s, full_dictionary(s, d)).rank(req, cand, 5).select("jd_id", "cv_id", r6("score").alias("score"), "place")


@query("search_texts")
def _(s, d):
    """The search endpoint: evaluation texts against the index of documents."""
    from skillweave.engine import Engine
    from skillweave.operators.features import HashedEmbedder, embed, text_key

    e = HashedEmbedder()
    t = texts(s, d)
    vecs = t.withColumn("key", text_key(e, "text")).join(embed(t.select("text"), e), "key").select(F.col("doc_id").alias("item_id"), "vec")
    st = _new_store(s, "search")
    st.build(vecs)
    q = table(s, d, "eval_item").select(F.col("item_id").alias("query_id"), "text")
    return Engine(s, None, embedder=e).search(st, q, 10).select("query_id", "item_id", r6("score").alias("score"), "place")
