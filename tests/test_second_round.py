"""Cases found in review: repeated candidates, the fuzzy tier, annotations, the index, the shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave import runtime
from skillweave.engine import Engine
from skillweave.operators import features, ranker, skills, spans
from skillweave.schema import RankerConfig
from skillweave.sources.index_store import IndexStore

ALIASES = "alias string, canonical string, rank struct<ord:string,pos:int>"


def aliases(spark):
    return spark.createDataFrame([("python", "python", ("1", 0)), ("machine learning", "machine learning", ("2", 0)), ("ml", "machine learning", ("2", 1))], ALIASES)


def test_a_repeated_candidate_changes_nothing(spark):
    req = spark.createDataFrame([("j", "python and machine learning", "team work")], "jd_id string, job_requirement string, job_description string")
    rows = [("j", "c1", "python developer"), ("j", "c2", "gardener"), ("j", "c3", "machine learning and python, team work")]
    run = lambda r: [tuple(x) for x in Engine(spark, aliases(spark)).rank(req, spark.createDataFrame(r, "jd_id string, cv_id string, resume_text string"), 10).orderBy("place").collect()]
    once = run(rows)
    assert [r[1] for r in once] == ["c3", "c1", "c2"] or len({r[1] for r in once}) == 3
    assert run([*rows, rows[2], rows[2]]) == once


def test_candidates_are_the_first_different_phrases(spark):
    docs = spark.createDataFrame([(1, "alpha beta python beta alpha beta"), (2, None), (3, "x")], "doc_id bigint, text string")
    got = [r["gram"] for r in skills.candidates(docs, aliases(spark)).orderBy("doc_id", "pos").collect()]
    toks = ["alpha", "beta", "python", "beta", "alpha", "beta"]
    want = list(dict.fromkeys(" ".join(toks[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(toks) - n + 1)))
    assert got == [g for g in want if g != "python"]
    assert [r["gram"] for r in skills.candidates(docs, aliases(spark), first=2).orderBy("pos").collect()] == ["alpha", "beta"]


def test_the_fuzzy_tier_against_brute_force(spark):
    e = features.HashedEmbedder(256)
    docs = spark.createDataFrame([(1, "pythons for machine learnings"), (2, "gardening"), (3, "python"), (4, None)], "doc_id bigint, text string")
    mean = {"python": e.encode(["python"])[0], "machine learning": e.encode(["machine learning", "ml"]).mean(0)}
    want = {1: set(), 2: set(), 3: {"python"}, 4: set()}
    for r in skills.candidates(docs, aliases(spark)).collect():
        v = e.encode([r["gram"]])[0]
        best = max(sorted(mean), key=lambda k: float(np.dot(v, mean[k])))
        if np.dot(v, mean[best]) >= 0.5:
            want[r["doc_id"]].add(best)
    tier = skills.FuzzyTier(e, at_least=0.5)
    assert {r["doc_id"]: set(r["skills"]) for r in skills.extract(docs, aliases(spark), tier).collect()} == want
    assert want[1] and {r["doc_id"]: r["skills"] for r in skills.extract(docs, aliases(spark)).collect()} == {1: [], 2: [], 3: ["python"], 4: []}


def test_a_batch_of_candidates_with_nothing_near_is_no_error(spark):
    docs = spark.createDataFrame([(1, "zzzz qqqq"), (2, "xxxx")], "doc_id bigint, text string")
    assert skills.fuzzy(docs, aliases(spark), skills.FuzzyTier(features.HashedEmbedder(256))).collect() == []
    assert {r["doc_id"]: r["skills"] for r in skills.extract(docs, aliases(spark), skills.FuzzyTier(features.HashedEmbedder(256))).collect()} == {1: [], 2: []}


def test_the_fuzzy_tier_writes_no_candidates(spark):
    import random
    from pathlib import Path

    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(130)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = written()
    assert skills.extract(docs, aliases(spark), skills.FuzzyTier(features.HashedEmbedder(32))).count() == 150
    assert written() - before <= 2 * sum(map(len, texts))


def test_the_fuzzy_tier_takes_the_same_candidates_where_they_are_encoded(spark):
    texts = [
        "Write to A.B@x.com or see https://a.b/c and WWW.x.org", "<b>alpha</b> beta < gamma", "GoLang k8s CI/CD cicd nodejs react.js NextJS node.js xgolang", None, "", "the and of",
        "\u0130stanbul \u212aelvin caf\u00e9 na\u00efve", "c++ c# .net python-3 a/b x_y", "a\u00a0b\u3000c alpha\tbeta\nalpha beta", "x " * 40 + "w" * 70, " ".join(f"t{i}" for i in range(300)), "ml python machine learning ml",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = {r["doc_id"]: r["toks"] for r in docs.select("doc_id", F.array_join(skills.tokens("text"), " ").alias("toks")).collect()}
    assert {r["doc_id"]: r["toks"] for r in skills.cleaned_tokens(docs).collect()} == plain
    known = {"python", "machine learning", "ml"}
    for words, first in ((4, 500), (2, 7)):
        want: dict[int, list[str]] = {k: [] for k in plain}
        for r in skills.candidates(docs, aliases(spark), words, first).orderBy("doc_id", "pos").collect():
            want[r["doc_id"]].append(r["gram"])
        assert {k: skills.candidate_list(t.split(" "), known, skills.candidate_lengths(words), first) for k, t in plain.items()} == want


def test_the_fuzzy_tier_may_forget(spark):
    docs = spark.createDataFrame([("a", "pythons for machine learnings"), (None, "pythons"), ("b", "pythons"), ("c", None)], "doc_id string, text string").coalesce(1)
    tier = skills.FuzzyTier(features.HashedEmbedder(256), at_least=0.5)
    once, again = (sorted(map(tuple, skills.fuzzy(docs, aliases(spark), tier, block, kept).collect()), key=str) for block, kept in ((4096, 1000), (1, 0)))
    assert once == again and {d for d, _ in once} == {"a", None, "b"}
    assert skills.fuzzy(docs, aliases(spark).limit(0), tier).count() == 0


def test_single_precision_loses_no_near_skill():
    rnd = np.random.default_rng(4)
    mean, v = rnd.normal(size=(300, 64)), rnd.normal(size=(500, 64))
    s = np.round(v @ mean.T, 9)
    for at_least in (float(s.max(1)[7]), float(np.median(s.max(1))), -1e9, 1e9):
        want = np.where(s.max(1) >= at_least, s.argmax(1), -1)
        assert (skills.nearest(v, mean, at_least, 64) == want).all()


def test_words_met_before_are_encoded_alike():
    import zlib

    e, texts = features.HashedEmbedder(64), ["alpha beta alpha", "", " ".join(f"w{i}" for i in range(6000)), "w1 w5999 alpha", "x"]
    for t, got in zip(texts, e.encode(texts)):
        want = np.zeros(64)
        for w in t.split():
            for g in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                h = zlib.crc32(g.encode())
                want[h % 64] += 1 if h >> 16 & 1 else -1
        assert (got == want / max(np.linalg.norm(want), 1e-12)).all()


def test_annotations_in_any_shape_are_moved_to_their_text(spark):
    lines = [
        (1, '{"text": "we use python and sql", "labels": [[7, 13, "HARD"], ["18", "21", "HARD"]]}'),
        (2, '{"text": "we use python and sql", "labels": [{"start": 0, "end": 6, "label": "HARD", "text": "python"}, {"start": 8, "end": 10, "label": "X", "text": "yt"}, {"start": 1, "end": 2, "label": "X", "text": "java"}]}'),
        (3, "no json"), (4, '{"text": "t", "labels": [["a", 2, "X"]]}'), (5, None), (6, '{"text": "t"}'),
    ]
    got = spans.reanchored(spans.parse_annotations(spark.createDataFrame(lines, "doc_id bigint, value string")))
    assert sorted((r["doc_id"], r["start"], r["end"], r["piece"]) for r in got.collect()) == [(1, 7, 13, "python"), (1, 18, 21, "sql"), (2, 7, 13, "python")]


def test_greedy_choice_agrees_with_the_table_form(spark):
    import random

    rnd = random.Random(5)
    found = [(s, s + rnd.randint(1, 6), f"k{rnd.randint(0, 4)}", rnd.choice(["high", "acronym", "low", "token"]), "m", 1.0) for s in (rnd.randint(0, 40) for _ in range(60))]
    df = spark.createDataFrame([(1, *f) for f in found], spans.HIT)
    for by in ("source", "start"):
        assert sorted(tuple(r)[1:] for r in spans.resolve(df, by).collect()) == sorted(spans.pick(found, by))


def test_a_bad_build_keeps_the_index_and_missing_times_count(spark, tmp_path):
    st = IndexStore(spark, f"file://{tmp_path}/ix")
    st.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id bigint, vec array<double>").withColumn("updated_at", F.lit(None).cast("timestamp")))
    assert st.load().count() == 2
    with pytest.raises(ValueError, match="lengths"):
        st.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0])], "item_id bigint, vec array<double>"))
    assert st.load().count() == 2


def test_a_hot_group_does_not_break_the_bound_on_fitted_rows(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") / 5000).alias("x"))
    m = ranker.LambdaMart(RankerConfig(features=("x",), n_trees=1, max_rows=300, max_group_rows=200)).fit(df, "g", "y")
    assert len(m.trees) == 1


def test_the_shared_folder_must_be_named_off_local_masters():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Fake)
