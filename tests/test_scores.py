import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.functions import text
from skillweave.operators import bm25, knn, metrics, norm, occupation, ranker, skills, spans
from skillweave.schema import RankerConfig, require_columns

PAIRS = [
    ("jd-1", 1, "Python FastAPI PostgreSQL Docker; CI/CD GitHub Actions; AWS ECS"),
    ("jd-1", 2, "Python Django MySQL; some Docker"),
    ("jd-1", 3, "Java Spring; Oracle; no Python"),
]


def okapi(corpus, query, k1=1.5, b=0.75):
    n = len(corpus)
    avg = sum(map(len, corpus)) / n
    df = Counter(t for d in corpus for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return [sum(idf.get(q, 0) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(d) / avg)) for q in query) for d in corpus for tf in [Counter(d)]]


def test_bm25_of_the_sample(spark):
    docs = spark.createDataFrame(PAIRS, "grp string, row_id int, t string").select("grp", "row_id", text.tokens("t").alias("toks"))
    q = spark.createDataFrame([("jd-1", "Must-have: Python FastAPI PostgreSQL Docker.")], "grp string, t string").select("grp", text.tokens("t").alias("toks"))
    got = {r["row_id"]: r["score"] for r in bm25.score(docs, bm25.query_terms(q)).collect()}
    assert [round(got[i], 6) for i in (1, 2, 3)] == [0.896494, 0.086258, 0.086258]


def test_bm25_against_the_formula(spark):
    rnd = random.Random(3)
    vocab = [f"t{i}" for i in range(12)]
    groups = {g: [[rnd.choice(vocab) for _ in range(rnd.randint(0, 15))] for _ in range(rnd.randint(2, 8))] + [["t0"]] for g in ("a", "b", "c")}
    query = {g: [rnd.choice(vocab + ["none"]) for _ in range(6)] for g in groups}
    docs = spark.createDataFrame([(g, i, d) for g, c in groups.items() for i, d in enumerate(c)], "grp string, row_id int, toks array<string>")
    q = spark.createDataFrame(list(query.items()), "grp string, toks array<string>")
    got = {(r["grp"], r["row_id"]): r["score"] for r in bm25.score(docs, bm25.query_terms(q)).collect()}
    for g, c in groups.items():
        for i, want in enumerate(okapi(c, query[g])):
            assert got[g, i] == pytest.approx(want, abs=1e-9)


def test_bm25_without_query_or_words_is_zero(spark):
    docs = spark.createDataFrame([("a", 1, []), ("a", 2, [])], "grp string, row_id int, toks array<string>")
    q = spark.createDataFrame([], "grp string, term string, qtf int")
    assert {r["score"] for r in bm25.score(docs, q).collect()} == {0.0}


def test_norms_of_the_sample(spark):
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate((3, 1, 2, 2))] + [("one", 9, 5.0)], "g string, i int, x double")
    want = {"zscore": [1.414214, -1.414214, 0, 0], "softmax": [0.534447, 0.072329, 0.196612, 0.196612], "rank": [1, 0, 0.333333, 0.666667], "minmax": [1, 0, 0.5, 0.5]}
    for m, w in want.items():
        got = {r["i"]: r["v"] for r in norm.normalize(df, m, "g", "x", "v", "i").collect()}
        assert [round(got[i], 6) for i in range(4)] == w, m
        assert got[9] == pytest.approx(1.0 if m == "softmax" else 0.0)
    with pytest.raises(ValueError):
        norm.normalize(df, "other", "g", "x", "v")


def test_ndcg_of_the_sample(spark):
    df = spark.createDataFrame([("g", s, y, i) for i, (s, y) in enumerate(zip((0.9, 0.8, 0.7, 0.6), (0, 2, 1, 0)))], "g string, s double, y int, i int")
    for gain, want in (("exp", 0.659002), ("linear", 0.669672)):
        assert round(metrics.ndcg(df, "g", "s", "y", "i", 5, gain).first()["ndcg"], 6) == want


def test_coverage(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c", "d"]), (["a"], [])], "h array<string>, w array<string>")
    assert [r[0] for r in df.select(skills.coverage(F.col("h"), F.col("w"))).collect()] == [0.5, 0.0]


def test_auc_with_ties(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 5) / 5, rnd.randint(0, 1)) for _ in range(60)]
    m = metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", F.col("y") == 1).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert m["roc_auc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    assert metrics.auc(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", F.col("y") == 1).first()["roc_auc"] is None


DICT = [("python", ["py", "python3"]), ("fastapi", ["fast api", "fast-api"]), ("postgresql", ["postgres", "postgre sql", "postgres sql"]), ("docker", []), ("aws", ["amazon web services"]), ("c++", []), (".net", [])]


def test_skill_extraction(spark):
    a = skills.alias_table(spark.createDataFrame([(i, c, al) for i, (c, al) in enumerate(DICT)], "ord int, canonical string, aliases array<string>"))
    texts = ["Experienced in PYTHON3 and Fast API; using Postgres + Docker on Amazon Web Services.", "py python Python3; fast-api FAST API; postgres postgre sql", "", None, "c++ and .net but not xc++ nor pyx or dockers"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string").select("doc_id", text.clean_text("t").alias("text"))
    got = {r["doc_id"]: set(r["skills"]) for r in skills.extract(docs, a).collect()}
    assert got == {0: {"python", "fastapi", "postgresql", "docker", "aws"}, 1: {"python", "fastapi", "postgresql"}, 2: set(), 3: set(), 4: {"c++", ".net"}}


def test_merge_dictionaries(spark):
    sch = "canonical string, aliases array<string>"
    a, b = spark.createDataFrame([("x", ["A", "b"]), ("y", None)], sch), spark.createDataFrame([("x", ["a", "c  d", None])], sch)
    assert {r[0]: r[1] for r in skills.merge_dictionaries(a, b).collect()} == {"x": ["A", "b", "c d"], "y": []}


def test_exact_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id bigint, vec array<double>").repartition(3)
    q = df.filter("item_id % 50 = 0").selectExpr("item_id AS query_id", "vec")
    for metric, score in (("ip", lambda i: v @ v[i]), ("l2", lambda i: -((v - v[i]) ** 2).sum(1))):
        got = {}
        for r in knn.exact_topk(df, q, 7, metric, block=3).collect():
            got.setdefault(r["query_id"], {})[r["place"]] = r["item_id"]
        for i, places in got.items():
            assert [places[p] for p in range(1, 8)] == np.argsort(-score(i), kind="stable")[:7].tolist()
    assert knn.exact_topk(df.limit(0), q, 3).count() == 0


def test_inverted_lists_reach_the_recall(spark):
    d = "/root/testdata/sf0.01/embeddings.parquet"
    e = spark.read.parquet(d).selectExpr("vec_id AS item_id", "transform(embedding, x -> double(x)) AS vec")
    from skillweave.functions.vectors import l2_normalize

    u = e.select("item_id", l2_normalize("vec").alias("vec")).cache()
    q = u.filter("item_id % 100 = 0").selectExpr("item_id AS query_id", "vec")
    want = {(r["query_id"], r["item_id"]) for r in knn.exact_topk(u, q, 10).collect()}
    got = {(r["query_id"], r["item_id"]) for r in knn.ivf_topk(u, q, 10).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_rank_drops_single_rows_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 2.0), ("b", "x", 1.0)], "g string, i string, p double")
    assert [(r["i"], r["place"]) for r in ranker.rank(df, "g", "p", "i", 2).orderBy("place").collect()] == [("z", 1), ("x", 2)]
    assert ranker.rank(df, "g", "p", "i").count() == 3


def test_lambdamart_learns_and_is_monotone(tmp_path, spark):
    rng = np.random.default_rng(5)
    x = rng.random((600, 2))
    y = (x[:, 0] * 3).astype(int)
    qid = np.repeat(np.arange(30), 20)
    cfg = RankerConfig(features=("a", "b"), n_trees=20)
    m = ranker.LambdaMart(cfg).fit_arrays(x, y, qid)
    p = m.predict_arrays(x)
    assert np.corrcoef(p, y)[0, 1] > 0.8
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.5)])
    assert (np.diff(m.predict_arrays(grid)) >= -1e-12).all()
    m.save(str(tmp_path / "m.json"))
    again = ranker.LambdaMart.load(str(tmp_path / "m.json"))
    df = spark.createDataFrame(x[:20].tolist(), "a double, b double")
    assert np.allclose([r["pred"] for r in again.predict(df).collect()], p[:20])
    assert np.allclose([r[0] for r in df.select(again.column()).collect()], p[:20])


def test_label_encoding(spark):
    df = spark.createDataFrame([("good",), ("bad",)], "l string")
    assert [r["y"] for r in ranker.encode_labels(df, "l", {"bad": 0, "good": 2}).collect()] == [2, 0]
    with pytest.raises(Exception, match="unmapped"):
        ranker.encode_labels(df, "l", {"bad": 0}).collect()


def test_windows_and_relaxed_matches():
    low = "big data from quality of the inspection textile team".split()
    assert spans.token_window_all("x textile big quality inspection y".split(), ["textile", "quality", "inspection"]) == [(1, 4, "token", 0.5)]
    assert spans.token_window(low, ["a", "b"]) == []
    assert spans.token_window("textile quality x".split(), ["textile", "quality", "inspection", "team"], 0.5)[0][:2] == (0, 2)
    assert spans.relaxed_subsequence("machine deep learning".split(), ["machine", "learning"]) == [(0, 2, "low", 1.0)]
    assert spans.relaxed_subsequence("rest api x".split(), ["rest", "api", "design"]) == [(0, 1, "low", 0.6 + 0.4 * 2 / 3)]
    assert spans.relaxed_subsequence("machine x".split(), ["machine", "learning"]) == []


def test_span_resolution(spark):
    hits = [(1, 0, 5, "a", "low", "abcde", 1.0), (1, 3, 6, "b", "high", "def", 1.0), (1, 6, 9, "c", "token", "ghi", 1.0), (1, 4, 5, "d", "high", "e", 1.0)]
    df = spark.createDataFrame(hits, spans.HIT)
    assert {r["skill_id"] for r in spans.resolve(df).collect()} == {"b", "c"}
    assert {r["skill_id"] for r in spans.resolve(df, "start").collect()} == {"a", "c"}


def test_tiers_and_export(spark):
    docs = spark.createDataFrame([(1, "Credit Risk and SQL; sql too, credit  risk")], "doc_id bigint, text string")
    pats = spark.createDataFrame([("s1", "high", "credit risk", False), ("s2", "acronym", "SQL", True)], "skill_id string, source string, form string, case_sensitive boolean")
    got = {(r["start"], r["end"], r["skill_id"], r["match"]) for r in spans.tier_hits(docs, pats).collect()}
    assert got == {(0, 11, "s1", "Credit Risk"), (16, 19, "s2", "SQL"), (30, 42, "s1", "credit  risk")}
    sk = spark.createDataFrame([("s1", "Credit Risk", "Skill"), ("s2", "SQL", "Skill")], "skill_id string, skill_name string, skill_type string")
    import json

    line = json.loads(spans.training_examples(docs, spans.tier_hits(docs, pats), sk).first()["value"])
    assert line["labels"][0] == [0, 11, "Skill"] and line["text"] == docs.first()["text"]
    a = spans.annotation(docs, spans.tier_hits(docs, pats), sk).first()
    assert a["unique_skills"]["s1"]["occurrences"] == 2
    assert spans.reanchor("xx skill yy", 0, 5, "skill") == (3, 8)


def test_packs(spark):
    p = spark.createDataFrame([("s", "essential", "x", ["A", "a"]), ("s", "optional", "x", ["b"]), ("s", "optional", "y", [])], "slug string, bucket string, canonical string, aliases array<string>")
    sl = spark.createDataFrame([("s",)], "slug string")
    assert {tuple(r) for r in occupation.pack_buckets(p, sl).collect()} == {("x", "essential"), ("y", "optional")}
    assert {r[0]: r[1] for r in occupation.pack_dictionary(p, sl).collect()} == {"x": ["A", "b"], "y": []}
    with pytest.raises(KeyError):
        occupation.pack_dictionary(p, spark.createDataFrame([("t",)], "slug string"))


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.range(1), ["id", "b"])


def test_occupations_in_blocks(spark):
    occ = spark.createDataFrame([("a", "data engineer", "builds pipelines"), ("b", "chef", "cooks"), ("c", "data analyst", "reports")], "occ_id string, label string, text string")
    q = spark.createDataFrame([(1, "Data Engineer wanted"), (2, None)], "query_id bigint, text string")
    got = {(r["query_id"], r["place"]): r["occ_id"] for r in occupation.simple_topk(q, occ, 2, block=2).collect()}
    assert got[1, 1] == "a" and got[1, 2] == "c" and (2, 1) in got
    want = 0.6 * text.ratio("data engineer", "data engineer wanted") + 0.4 * 2 / 5
    assert occupation.simple_topk(q, occ, 1).filter("query_id = 1").first()["score"] == pytest.approx(want)
