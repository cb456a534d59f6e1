import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from skillweave.functions import ids, location, text


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]


def test_tokens_of_the_sample_pair(spark):
    assert one(spark, text.tokens, "Must-have: Python, FastAPI, PostgreSQL, Docker. Nice: AWS.") == ["must-have", "python", "fastapi", "postgresql", "docker.", "aws."]
    assert one(spark, text.tokens, "Python FastAPI PostgreSQL Docker; CI/CD; AWS ECS") == ["python", "fastapi", "postgresql", "docker", "ci", "cd", "aws", "ecs"]
    assert "kubernetes" in one(spark, text.tokens, "Data engineer: Python, Kafka, PostgreSQL; Docker; K8s")
    assert one(spark, text.tokens, None) == []
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS))


def test_clean_text_removes_tags_links_and_addresses(spark):
    assert one(spark, text.clean_text, " <b>Go</b>  to https://x.y/z or\nmail a.b@c.org Golang ") == "go to or mail go"
    assert one(spark, text.clean_html, "R&amp;D &lt;b&gt;x\u0007 ﬁne") == "r&d x fine"


def test_stable_ids(spark):
    assert one(spark, lambda c: ids.stable_id(c, "jd"), "Must-have: Python, FastAPI, PostgreSQL, Docker. Nice: AWS.") == "jd-ac8b5172ece6"
    assert one(spark, lambda c: ids.stable_id(c, "cv"), "Python FastAPI PostgreSQL Docker; CI/CD; AWS ECS") == "cv-22473b518ee0"


def test_ensure_ids_remakes_the_whole_column_if_any_is_null(spark):
    df = spark.createDataFrame([("a", "x"), (None, "y")], "id string, t string")
    assert all(r["id"].startswith("cv-") for r in ids.ensure_ids(df, "id", "t", "cv").collect())
    assert {r["id"] for r in ids.ensure_ids(df.filter("id = 'a'"), "id", "t", "cv").collect()} == {"a"}


def test_merge_jd(spark):
    for a, b, want in (("req", "desc", "req\n\ndesc"), ("req", "", "req"), ("", "desc", "desc"), (None, None, "")):
        assert one(spark, text.merge_jd, a, b) == want


def test_small_functions(spark):
    assert one(spark, text.abbreviation, "Amazon Web Services (AWS)") == "AWS"
    assert one(spark, text.abbreviation, "Word (basic)") == ""
    assert one(spark, text.sub_forms, "Use of R&D and S.Q.L in IT (AB)") == ["R&D", "S.Q.L", "IT"]
    assert one(spark, text.clean_label, "C++ (a (b) c) / Go!") == "c go"
    assert one(spark, text.slugify, "  Kỹ sư Đà Nẵng  ") == "ky_su_da_nang"
    assert one(spark, text.slugify, "!!!") == "unknown"
    assert one(spark, text.strip_accents, "Kỹ năng đá") == "Ky nang đa"
    assert one(spark, text.is_acronym, "S.Q.L") and not one(spark, text.is_acronym, "Sql")
    assert one(spark, text.looks_vietnamese, "kỹ năng") and not one(spark, text.looks_vietnamese, "skill")
    assert one(spark, text.label_parts, "A\\na\nB  c\nx") == ["B c"]
    assert one(spark, text.label_parts, "Ab\\nab\nB  c") == ["Ab", "B c"]
    assert one(spark, text.comma_list, "a, ,b ,") == ["a", "b"]


def test_porter_stems():
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sized", "size"), ("happy", "happi"), ("relational", "relat"), ("engineering", "engin"), ("effective", "effect"), ("controll", "control"), ("falling", "fall")):
        assert text.porter(w) == s, (w, text.porter(w))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc ÀéđA.,-+1", max_size=20), min_size=1, max_size=5))
def test_strip_accents_agrees_with_unicode(spark, values):
    import unicodedata

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for r in df.select("v", text.strip_accents("v").alias("p")).collect():
        assert r["p"] == "".join(c for c in unicodedata.normalize("NFD", r["v"]) if unicodedata.category(c) != "Mn")


def test_location_scores_of_the_sample(spark):
    jd, place = "We are hiring a Backend Engineer (onsite).", "District 1, Ho Chi Minh City, Vietnam"
    for cv, want in (("Thu Duc, Ho Chi Minh City, Vietnam", 0.9), ("Hanoi, Vietnam", 0.8), ("Singapore", 0.6), ("Ho Chi Minh City, Vietnam", 0.8), (None, 0.85)):
        assert one(spark, location.score_pair, jd, place, cv) == want, cv
    assert one(spark, location.score_pair, "fully remote", place, "Singapore") == 1.0
    assert one(spark, location.score_pair, jd, None, "Singapore") == 1.0


def test_dense_code_and_positions(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "i int, t string")
    got = {r["i"]: r["code"] for r in ids.dense_code(df, F.col("t"), F.col("i"), "code").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}
