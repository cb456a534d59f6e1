import json

import pytest
from pyspark.sql import functions as F

from skillweave.engine import Engine
from skillweave.operators import dictionary, skills
from skillweave.operators.features import HashedEmbedder
from skillweave.sources import files, tables
from skillweave.sources.index_store import IndexStore, VectorCache
from skillweave.streaming import flows


def test_csv_round_trip_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([('a "q"\nb', "1"), ("c,d", "2")], "t string, n string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, df.collect()))


def test_pairs_with_mapped_labels(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("resume_text,job_description_text,label\na,b,Good Fit\nc,d,1\ne,,2\n")
    got = files.read_pairs(spark, str(p), {"No Fit": 0, "Potential Fit": 1, "Good Fit": 2}).collect()
    assert sorted(r["label"] for r in got) == [1, 2]
    p.write_text("x\n1\n")
    with pytest.raises(ValueError):
        files.read_pairs(spark, str(p))


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"cat": {"Python": ["Py", None, "py"], "Go": None}}))
    (tmp_path / "b.json").write_text(json.dumps({"other": {"python": ["Python3"]}}))
    (tmp_path / "c.json").write_text("{broken")
    got = {r["canonical"]: r["aliases"] for r in files.read_dictionary(spark, str(tmp_path)).collect()}
    assert got == {"python": ["py", "python3"], "go": []}


def test_occupations_and_packs(spark, tmp_path):
    p = tmp_path / "o.tsv"
    p.write_text("﻿occ_id\ttext\n1\tData engineer | builds\n\tx\n2\t\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_occupations(spark, str(p)).collect()] == [("1", "Data engineer", "Data engineer | builds", "data_engineer")]
    j = tmp_path / "p.json"
    j.write_text(json.dumps({"s": {"essential": {"x": ["a"]}, "optional": {"y": []}}}))
    assert {(r["bucket"], r["canonical"]) for r in files.read_packs(spark, str(j)).collect()} == {("essential", "x"), ("optional", "y")}


def test_broken_files_do_not_stop_the_scan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello   there")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in files.read_files(spark, str(tmp_path), lambda b: b.decode()).collect()}
    assert got["a.bin"] == ("hello there", None) and "UnicodeDecodeError" in got["b.bin"][1]


def test_json_outputs(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b", 2)], "t string, n int")
    files.write_json_array(df, str(tmp_path / "a"))
    assert sorted(r["t"] for r in json.loads(spark.read.option("wholetext", True).text(str(tmp_path / "a")).first()[0])) == ["b", "é"]
    files.append_jsonl(df, str(tmp_path / "l"))
    files.append_jsonl(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    files.write_version(df, str(tmp_path / "v"), 1)
    files.write_version(df.limit(1), str(tmp_path / "v"), 2)
    assert files.read_latest(spark, str(tmp_path / "v")).count() == 1


def test_gold_pieces(spark):
    df = spark.createDataFrame([(1, "I know SQL well", [(7, 10, "SKILL"), (0, 1, "X")])], "doc_id bigint, text string, entities array<struct<start:int,end:int,label:string>>")
    assert files.gold_from_entities(df).first()["skills"] == ["sql"]


def test_seed_defaults(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"jds": [{"job_title": "a"}], "cvs": [{"resume_text": "b"}]}))
    jds, cvs = files.read_seed(spark, str(p))
    assert tuple(jds.first()) == ("a", "", "", "") and tuple(cvs.first()) == ("b", "")


def test_latest_and_links(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 3, 1)], "id string, rev int, at int")
    assert {tuple(r) for r in tables.latest(df, "id", ["at", "rev"]).collect()} == {("a", 1, 5), ("b", 3, 1)}
    l, r = spark.range(20).withColumnRenamed("id", "l"), spark.range(7).withColumnRenamed("id", "r")
    got = tables.sample_links(l, r, "l", "r", 3).collect()
    assert len(got) == 60 and len(set(map(tuple, got))) == 60


def test_index_store(spark, tmp_path):
    st = IndexStore(spark, str(tmp_path / "i"))
    assert not st.exists()
    with pytest.raises(ValueError):
        st.build(spark.createDataFrame([], "item_id bigint, vec array<double>"))
    st = IndexStore(spark, str(tmp_path / "j"))
    st.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "item_id bigint, vec array<double>").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp")))
    q = spark.createDataFrame([(9, [0.0, 3.0])], "query_id bigint, vec array<double>")
    assert [r["item_id"] for r in st.search(q, 1).collect()] == [2]
    st.append(spark.createDataFrame([(2, [1.0, 1.0], False)], "item_id bigint, vec array<double>, is_active boolean"))
    assert [r["item_id"] for r in st.search(q, 5).collect()] == [1]
    assert st.meta().first()["count"] == 1


def test_vector_cache_keeps_first(spark, tmp_path):
    c = VectorCache(spark, str(tmp_path / "c"))
    assert c.get() is None
    c.put(spark.createDataFrame([("a", [1.0])], "key string, vec array<double>"))
    c.put(spark.createDataFrame([("a", [2.0]), ("b", [3.0])], "key string, vec array<double>"))
    assert {r["key"]: r["vec"] for r in c.get().collect()} == {"a": [1.0], "b": [3.0]}


def test_stream_keeps_one_vector_per_id(spark, tmp_path):
    src = str(tmp_path / "src")
    sch = "item_id bigint, text string, updated_at timestamp, is_active boolean"
    for n, rows in enumerate(([(1, "a b"), (2, "c d")], [(1, "e f"), (3, "a b")])):
        spark.createDataFrame([(i, t) for i, t in rows], "item_id bigint, text string").withColumn("updated_at", F.lit(f"2024-01-0{n + 1}").cast("timestamp")).withColumn("is_active", F.lit(True)).coalesce(1).write.mode("append").parquet(src)
    st, cache = IndexStore(spark, str(tmp_path / "i")), VectorCache(spark, str(tmp_path / "c"))
    flows.keep_index(flows.stream_table(spark, src, sch), st, HashedEmbedder(8), cache, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["item_id"] for r in st.load().collect()) == [1, 2, 3]
    assert cache.get().count() == 3


def test_stream_windows(spark, tmp_path):
    sch = "ts timestamp, event_type string, value double, user_id bigint"
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value, 1L user_id UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D, 1L").write.parquet(str(tmp_path / "e"))
    got = flows.run_to_table(flows.windowed(flows.stream_table(spark, str(tmp_path / "e"), sch)), "complete").collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 3.0)]


def aliases(spark):
    return skills.alias_table(spark.createDataFrame([(0, "python", ["py"]), (1, "docker", []), (2, "aws", [])], "ord int, canonical string, aliases array<string>"))


def test_engine_ranks_requests(spark):
    e = Engine(spark, aliases(spark))
    req = spark.createDataFrame([("j1", "Must-have: Python, Docker", "AWS"), ("j2", "", None)], "jd_id string, job_requirement string, job_description string")
    cand = spark.createDataFrame([("j1", "c1", "Python Docker AWS"), ("j1", "c2", "Java Spring"), ("j1", None, "some Docker"), ("j2", "c9", "x")], "jd_id string, cv_id string, resume_text string")
    rows = e.rank(req, cand, 2).orderBy("place").collect()
    assert [r["cv_id"] for r in rows][0] == "c1" and len(rows) == 2 and all(r["pred"] == r["score"] for r in rows)


def test_engine_search_needs_an_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine(spark, aliases(spark)).search(IndexStore(spark, str(tmp_path / "none")), spark.createDataFrame([(1, "x")], "query_id bigint, text string"))


def test_skill_processing(spark):
    raw = spark.createDataFrame([("1", "Amazon Web Services (AWS)", "t"), ("2", "Web Design", "t"), ("3", "Python", "t")], "skill_id string, skill_name string, skill_type string")
    got = {r["skill_id"]: r for r in dictionary.processed(raw).collect()}
    assert got["1"]["abbreviation"] == "AWS" and got["1"]["skill_len"] == 3 and got["1"]["unique_token"] == "amazon"
    assert got["2"]["unique_token"] == "design" and got["3"]["match_on_stemmed"]
    forms = {r["skill_id"]: r for r in dictionary.surface_forms(dictionary.processed(raw)).collect()}
    assert forms["3"]["low"] == ["python"] and forms["1"]["match_on_tokens"]
    assert forms["2"]["low"][:2] == ["web design", "design web"]


def test_alias_updates(spark):
    s = spark.createDataFrame([("kỹ năng sql", "1", 0.95, 4), ("go", "2", 0.99, 9), ("rare", "3", 0.99, 1)], "alias string, skill_id string, similarity double, freq int")
    assert [(r["alias"], r["language"], r["plain"]) for r in dictionary.accept_aliases(s).collect()] == [("kỹ năng sql", "vi", "ky nang sql")]
