"""Small cases of every operator: nulls, blanks, ties, repeats, empty tables, clashing columns, long texts."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.llm import canonical_dupes, canonical_map, cross_split, group_split, leakage, packing, pii, rank_fusion, residue, top_groups

TRAIN = "row_id bigint, jd_id string, cv_id string, job_description_text string, resume_text string, label int, source string"


def train(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], TRAIN)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# 1 -----------------------------------------------------------------------------------------------


def test_copies_in_other_formats(spark):
    a = "Summary: Data engineer, 5 years.\nSkills: SQL, Python"
    rows = [
        (1, "j", "c", "Title: X", a, 0, None), (2, "k", None, "TITLE  x!", "SKILLS\nsql; python | summary - data engineer 5 years", 1, "s"),
        (3, "j", "c", "Title: X", "Summary: Data engineer, 5 years.\nSkills: Python, SQL", 0, None), (4, "j", "c", None, a, 0, None), (5, "j", "c", "Title: X", "    ", 0, None),
        (6, "j", "c", "Title: X", a, 0, None), (7, "j", "c", None, a, 0, None),
    ]
    assert rows_of(canonical_dupes.found(train(spark, rows))) == [(1, 2), (1, 6)]
    assert canonical_dupes.found(train(spark, rows).limit(0)).count() == 0


def test_text_before_the_first_label_is_a_section(spark):
    rows = [(1, "j", "c", "x", "Intro words. Skills: a. Summary: b", 0, None), (2, "j", "c", "x", "Intro words. Summary: b. Skills: a", 0, None), (3, "j", "c", "x", "Words intro. Summary: b. Skills: a", 0, None)]
    assert rows_of(canonical_dupes.found(train(spark, rows))) == [(1, 2)]


def test_a_hot_group_of_copies_and_no_collisions(spark):
    rows = [(i, "j", "c", "Title x", "same text" if i % 3 == 0 else f"text {i}", 0, None) for i in range(3000)]
    p = canonical_dupes.fingerprints(train(spark, rows), "row_id").cache()
    got = rows_of(canonical_dupes.surplus_copies(p))
    assert got == [(0, i) for i in range(3, 3000, 3)]
    assert canonical_dupes.collisions(canonical_dupes.collapse(p)).count() == 0


def test_clashing_column_names(spark):
    df = train(spark, [(1, "j", "c", "t", "a b", 0, None), (2, "j", "c", "t", "A  b.", 0, None)])
    for name in ("key", "check", "form", "copies", "keep_id", "n_chars"):
        df = df.withColumn(name, F.lit("x"))
    assert rows_of(canonical_dupes.found(df)) == [(1, 2)]


# 2 -----------------------------------------------------------------------------------------------


def words(t):
    return set(re.findall(r"[^\W_]+", t.lower()))


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    base = [(" ".join(rnd.sample(vocab, 30)), " ".join(rnd.sample(vocab, 12))) for _ in range(6)]

    def variant(t):
        ws = t.split()
        for _ in range(rnd.randint(0, 5)):
            ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
        rnd.shuffle(ws)
        return " ".join(ws).upper() if rnd.random() < 0.3 else ", ".join(ws)

    mk = lambda n, start: [(start + i, "j", "c", variant(b[1]), variant(b[0]), 0, None) for i in range(n) for b in [rnd.choice(base)]]
    tr, te = mk(60, 0), mk(25, 1000)
    tr += [(900, "j", "c", None, base[0][0], 0, None), (901, "j", "c", base[0][1], "", 0, None), (902, "j", "c", "---", "...", 0, None)]
    te += [(1900, "j", "c", "---", "...", 0, None), (1901, "j", "c", base[0][1], None, 0, None)]
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = sorted((a[0], b[0]) for a in tr for b in te if a[3] and a[4] and b[3] and b[4] and jac(words(a[4]), words(b[4])) >= 0.8 and jac(words(a[3]), words(b[3])) >= 0.8)
    whole = cross_split.overlaps(train(spark, tr), train(spark, te)).collect()
    texts = {r[0]: words(r[4]) for r in (*tr, *te) if r[4]}
    assert all(0 < r["dot"] and 0 < r["cosine"] <= 1 + 1e-9 for r in whole)
    assert all(r["cosine"] == pytest.approx(1) for r in whole if texts[r["train_row_id"]] == texts[r["test_row_id"]])
    got = sorted((r["train_row_id"], r["test_row_id"]) for r in whole)
    assert [x for x in got if x[0] < 900] == want and want
    assert cross_split.overlaps(train(spark, tr).limit(0), train(spark, te)).count() == 0


# 3 -----------------------------------------------------------------------------------------------

PII_CASES = {
    "Mail goes to a.b+jobs@mail.example or to the agency.": {("email", "a.b+jobs@mail.example")},
    "Write x_y (at) inbox.test. Audited": {("email", "x_y (at) inbox.test")},
    "(vy17[at]example[dot]org)": {("email", "vy17[at]example[dot]org")},
    "Wrote @decorator helpers and the @core package.": set(),
    "Call (202) 555-0108 after six.": {("phone", "(202) 555-0108")},
    "Số máy +84-100-339-048; Tel: (+84) 10.096.9064": {("phone", "+84-100-339-048"), ("phone", "(+84) 10.096.9064")},
    "WhatsApp 07700 900310 and 13035550195": {("phone", "07700 900310"), ("phone", "13035550195")},
    "Budget 5065000000 VND. Processed 63530073 parcels in 2021-2023.": set(),
    "Invoice no. 000154113771 was disputed. Scored 8.5 of 100 in course 404-86-6315.": set(),
    "CCCD số 000 351 565 630, SSN: 997 58 9276": {("id_number", "000 351 565 630"), ("id_number", "997 58 9276")},
    "Identity card QQ 49 41 27 C is valid; doc ZZ7453698 attached": {("id_number", "QQ 49 41 27 C"), ("id_number", "ZZ7453698")},
    "Card 4111 1111 1111 1111 but not 4111 1111 1111 1112": {("id_number", "4111 1111 1111 1111")},
    "IBAN GB82 WEST 1234 5698 7654 32 fine": {("id_number", "GB82 WEST 1234 5698 7654 32")},
    "Home address: Unit 26-14 Bramwick Terrace, Brambry.": {("address", "Unit 26-14 Bramwick Terrace")},
    "Flat 7, 148 Penquay Terrace, Lindmoor": {("address", "Flat 7, 148 Penquay Terrace")},
    "Based in Số 161 đường Bình Sa, Ostermere": {("address", "Số 161 đường Bình Sa")},
    "Drew the 5 Year Road map for buses. Took over the Movdrain Street depot with 45 vans.": set(),
    "My name is DIỆP LINSHION. Game programmer": {("name", "DIỆP LINSHION")},
    "Worked next to Ms. Odrun Fenkkois on audits": {("name", "Odrun Fenkkois")},
    "Candidate: Pelshiar, Namira; Referee: N. Yarggois, former": {("name", "Pelshiar, Namira"), ("name", "N. Yarggois")},
    "Won the Gavlfiix Prize for Holllmel College. Merged Ildzzeik & Velndiek Partners into one unit.": set(),
}


def test_pieces_of_texts(spark):
    df = spark.createDataFrame(list(enumerate([*PII_CASES, "", " "])) + [(99, None)], "row_key bigint, text string").withColumn("table_name", F.lit("t"))
    got = {}
    for r in pii.find(df.filter("text IS NOT NULL")).collect():
        got.setdefault(r["row_key"], set()).add((r["kind"], r["found_text"]))
    for i, (t, want) in enumerate(PII_CASES.items()):
        assert got.get(i, set()) == want, t


def test_unlabelled_names_by_the_mined_lexicon(spark):
    known = [f"My name is Namira {s}." for s in ("Aaaaa", "Bbbbb", "Ccccc")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*known, "QA tester. Namira Drollov; NumPy, Kestrel Bank. namira.x@y.example"])], "row_key bigint, text string").withColumn("table_name", F.lit("t"))
    assert {(r["kind"], r["found_text"]) for r in pii.find(df).filter("row_key = 3").collect()} == {("name", "Namira Drollov"), ("email", "namira.x@y.example")}
    lex = spark.createDataFrame([("Namira",)], "word string")
    assert [r["found_text"] for r in pii._bare_by_join(df.filter("row_key = 3"), lex).collect()] == ["Namira Drollov"]


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Tel: +44 7700 900 563 or mail a@b.example, 5 years"), (2, "nothing here"), (3, "")], "row_key bigint, text string").withColumn("table_name", F.lit("t"))
    got = {r["row_key"]: r["text"] for r in pii.redacted(df).collect()}
    assert got == {1: "Tel: [PHONE] or mail [EMAIL], 5 years", 2: "nothing here", 3: ""}


def test_redaction_cuts_by_place(spark):
    texts = ["My name is Ann Lee. The Ann Leeds award", "Card 4111 1111 1111 1111, tel: 555 0142; 5550142 units", None, "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "Mail a@b.example"), (1, "Mail a@b.example")], "row_key bigint, text string").withColumn("table_name", F.lit("t")).withColumn("start", F.lit(1))
    got = sorted((r["row_key"], r["text"] or "") for r in pii.redacted(df).collect())
    assert got == [(0, "My name is [NAME]. The Ann Leeds award"), (1, "Card [ID_NUMBER], tel: [PHONE]; 5550142 units"), (1, "Mail [EMAIL]"), (1, "Mail [EMAIL]"), (2, ""), (3, "  ")]


def test_context_raises_and_lowers(spark):
    texts = {"Seen 555 0142 today": set(), "Hotline: 555 0142 today": {("phone", "555 0142")}, "SSN: 123456789 given": {("id_number", "123456789")}, "Took 123456789 steps": set(), "Order no. 07700 900310 came": set(), "Reach me: 07700 900310": {("phone", "07700 900310")}, "Tel: 07700900 parcels": set()}
    df = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string").withColumn("table_name", F.lit("t"))
    got = {}
    for r in pii.spans(df).collect():
        got.setdefault(r["row_key"], set()).add((r["kind"], r["found_text"]))
        assert texts and list(texts)[r["row_key"]][r["start"] : r["start"] + len(r["found_text"])] == r["found_text"] and r["score"] >= pii.ACCEPT - 1e-9
    assert [got.get(i, set()) for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("tail", [" joined the team.", ". Then", ", who", "\n", " Lee-Marsh. x"])
def test_both_ways_to_bare_names_agree(spark, tail, monkeypatch):
    known = [f"My name is {n} {s}." for n in ("Namira", "Anna", "O’Brien") for s in ("Aaaaa", "Bbbbb", "Ccccc")]
    texts = [*known, *(f"{b}{n}{tail}" for n in ("Anna", "ANNA", "anna", "Anna Drollov", "ANNA DROLLOV", "anna drollov", "Drollov, Anna", "Namira J. Drollov", "Anna Namira Drollov") for b in ("Then ", "Signed, ", "", "x@", "and "))]
    df = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string").withColumn("table_name", F.lit("t"))
    small = rows_of(pii.find(df))
    monkeypatch.setattr(pii, "PATTERN_WORDS", 0)
    assert rows_of(pii.find(df)) == small


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB83WEST12345698765432")], "a string, b string")
    got = [tuple(r) for r in df.select(pii.luhn(F.col("a")), pii.mod97(F.col("b"))).collect()]
    assert got == [(True, True), (False, False)]
    assert [(pii.luhn_ok(r["a"]), pii.mod97_ok(r["b"])) for r in df.collect()] == got


# 4 -----------------------------------------------------------------------------------------------


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            parent[find("c:" + b.strip().lower())] = find("j:" + a.strip().lower())
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return list(out.values())


def test_components_against_union_find(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, f" J{rnd.randint(0, 40)}", f"j{rnd.randint(0, 40)}"]), rnd.choice([None, f"c{rnd.randint(0, 60)}"]), "t", "r", 0, None) for i in range(90)]
    rows += [(1000 + i, f"p{i}", f"q{i}", "t", "r", 0, None) for i in range(20)] + [(2000 + i, f"p{i + 1}", f"q{i}", "t", "r", 0, None) for i in range(19)]  # a long chain
    df = train(spark, rows)
    want = set()
    for c in components((r[1], r[2]) for r in rows):
        js = sorted(x[2:] for x in c if x[:2] == "j:")
        want |= {(js[0], x) for x in js[1:]}
    assert set(rows_of(group_split.linked_pairs(df))) == want
    assert group_split.linked_pairs(df.limit(0)).count() == 0


def test_splits_keep_components_together_and_near_the_shares(spark):
    rnd = random.Random(2)
    rows = [(i, f"j{rnd.randint(0, 2000)}", f"c{i if rnd.random() < 0.9 else rnd.randint(0, 5000)}", "t", "r", 0, None) for i in range(6000)] + [(9000, None, None, "t", "r", 0, None), (9001, None, None, "t", "r", 0, None)]
    df = train(spark, rows)
    a = group_split.assign(group_split.update(None, df), df).collect()
    assert len(a) == len(rows)
    by = {r["row_id"]: r["split"] for r in a}
    for key in (1, 2):
        seen = {}
        for r in rows:
            if r[key]:
                assert seen.setdefault(r[key], by[r[0]]) == by[r[0]]
    n = {s: sum(v == s for v in by.values()) / len(by) for s in group_split.PROPORTIONS}
    assert abs(n["train"] - 0.8) < 0.05 and abs(n["test"] - 0.1) < 0.05


def test_later_batches_keep_fill_and_quarantine(spark):
    first = train(spark, [(i, f"j{i}", f"c{i}", "t", "r", 0, None) for i in range(60)])
    state = group_split.update(None, first)
    split = {r["entity"]: r["split"] for r in state.collect()}
    a = next(k for k in split if k[0] == "j" and split[k] == "train")
    b = next(k for k in split if k[0] == "j" and split[k] != "train")
    c = next(k for k in split if k[0] == "j" and split[k] == "train" and k != a)
    more = train(spark, [(100, a[2:], "x1", "t", "r", 0, None), (101, b[2:], "x1", "t", "r", 0, None), (102, c[2:], "new", "t", "r", 0, None), (103, "fresh", "fresh", "t", "r", 0, None)])
    state = group_split.update(state, more)
    now = {r["entity"]: (r["component"], r["split"]) for r in state.collect()}
    assert now[a][1] == now[b][1] == now["c:x1"][1] == group_split.QUARANTINE and now[a][0] == now[b][0]
    assert now["c:new"] == now[c] and now[c][1] == "train"
    assert now["j:fresh"][1] in group_split.PROPORTIONS
    assert all(now[k][1] == split[k] for k in split if now[k][0] not in (now[a][0],))
    again = group_split.update(state, more.limit(0))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in state.collect()}


# 5 -----------------------------------------------------------------------------------------------


def test_top_n_with_ties_repeats_and_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "a", "a", " A", "b", None]), None, None, None, rnd.choice([0, 1, 2, None]), None) for i in range(500)] + [(900, "c", None, None, None, 1, None), (900, "c", None, None, None, 1, None)]
    want = []
    for g in ("a", "b", "c"):
        mine = {r[0]: r[5] for r in rows if r[1] and r[1].strip().lower() == g and r[5] is not None}
        want += [(g, i) for i in sorted(mine, key=lambda i: (-mine[i], i))[:5]]
    assert rows_of(top_groups.found(train(spark, rows))) == sorted(want)
    assert top_groups.found(train(spark, rows).limit(0)).count() == 0


# 6 -----------------------------------------------------------------------------------------------

SKILLS = [("1", "Python", ""), ("2", "C++", ""), ("3", "C#", ""), ("4", "Amazon Web Services (AWS)", "AWS"), ("5", "Marine Quality Inspection", ""), ("6", "Marine Waste Reduction", ""), ("7", "Product Management", ""), ("8", "React", ""), ("9", "React Native", ""), ("10", "R", ""), ("11", "Microsoft Azure", ""), ("12", "Perl", "")]
MAPPED = {
    "pythno": "1", "Ｐｙｔｈｏｎ": "1", "PY ": "1", "Python - advanced": "1", "basic python": "1", "python 6+ years": "1", "Python (4 yrs)": "1", "kỹ năng Python": "1", "c++": "2", "cpp": "2", "C#.": "3", "aws": "4", "AWS Amazon Web Services": "4",
    "Services, Amazon Web": "4", "Product Mgmnt": "7", "marine qlty inspection": "5", "MarineWasteReduction": "6", "marine.waste.reduction": "6", "Product Mgmt": "7", "reactive paint": "unmatched", "Reat Native": "9", "r: intermediate": "10", "ms azure": "11", "golf": "unmatched", "-": "unmatched", "Pearl diving": "unmatched",
}


def test_values_mean_entries(spark):
    sk = spark.createDataFrame(SKILLS, "skill_id string, skill_name string, abbreviation string")
    al = spark.createDataFrame([("1", "py"), ("2", "cpp")], "skill_id string, alias string")
    v = spark.createDataFrame([(x,) for x in [*MAPPED, *MAPPED]] + [(None,), (" ",), ("x" * 5000,)], "value string")
    got = {r["value"]: r["skill_id"] for r in canonical_map.map_values(v, sk, al).collect()}
    assert got.pop("x" * 5000) == "unmatched"
    assert got == MAPPED
    assert canonical_map.map_values(v.limit(0), sk, al).count() == 0


def test_similarity_join_loses_nothing_that_the_distance_accepts(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 7)))
    right = sorted({" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(60)} | {"hr management", "it management", "aaaa", "c d i", "lolololo", "data base"})

    def typed(f):
        for _ in range(rnd.randint(0, 3)):
            i, c = rnd.randrange(len(f)), rnd.choice("abcde ")
            f = rnd.choice([f[:i] + c + f[i:], f[:i] + f[i + 1 :], f[:i] + c + f[i + 1 :], f[:i] + f[i + 1 : i + 2] + f[i] + f[i + 2 :]]) or f
        ws = f.split()
        rnd.shuffle(ws)
        return rnd.choice([f, " ".join(ws), "".join(ws)])

    left = sorted({" ".join(x.split()) for f in right for x in [typed(f) for _ in range(8)] if x.strip()} | {"hr mgmt", "it mgmt", "cdi", "aaa", "database"})
    kinds = f"form string, {canonical_map.SETS}"
    rec = lambda x, slack: ([(g["kind"], g["edits"], g["grams"]) for g in canonical_map.gram_sets(x, slack)], canonical_map.short_keys(x))
    lf = spark.createDataFrame([(x, *rec(x, canonical_map.MOST_EDITS)) for x in left], kinds)
    rf = spark.createDataFrame([(str(i), 0, x, *rec(x, 0)) for i, x in enumerate(right)], "skill_id string, source int, ref_" + kinds)
    pairs = {(r["form"], r["ref_form"]) for d in (canonical_map.similar(lf, rf), canonical_map.abbreviated(lf, rf)) for r in d.collect()}
    wanted = {(a, b) for a in left for b in right if canonical_map.distance(a, b) is not None}
    assert wanted - pairs == set() and len(wanted) > 200
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    sets = lambda x, slack: [g["grams"] for g in canonical_map.gram_sets(x, slack)]
    for r in canonical_map.similar(lf, rf).collect():
        own = [jac(a, b) for a, b in zip(sets(r["form"], 3), sets(r["ref_form"], 0))]
        assert r["jaccard"] == pytest.approx(max(own))


# 7 -----------------------------------------------------------------------------------------------


def test_fusion_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, f"c{i}", rnd.choice([0.1, 0.5, 9.0, None, float("nan")]) if rnd.random() < 0.1 else rnd.random() * 100, rnd.random(), round(rnd.random(), 1)) for g in ("a", "b", "tiny") for i in range(40 if g != "tiny" else 3)]
    rows += rows[:5] + [(None, "c", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "jd_id string, cv_id string, bm25_full_norm double, emb_cosine_norm double, vendor_cov double").withColumn("rank", F.lit(1)).withColumn("item", F.lit("x"))
    want, full = set(), {}
    for g in ("a", "b", "tiny"):
        ok = {r[1]: r[2:] for r in rows if r[0] == g and all(x is not None and not math.isnan(x) for x in r[2:])}
        rrf = {c: round(sum(1 / (60 + 1 + sum(o[k] > v[k] for o in ok.values())) for k in range(3)), 12) for c, v in ok.items()}
        full |= {(g, c): x for c, x in rrf.items()}
        if len(ok) >= 10:
            want.add((g, min(rrf, key=lambda c: (-rrf[c], c))))
    assert set(map(tuple, rank_fusion.found(df).collect())) == want
    got = rank_fusion.ranking(df, rank_fusion.SCORES).collect()
    assert {(r["grp"], r["item"]): pytest.approx(r["rrf"], abs=1e-11) for r in got} == full
    for r in got:
        assert r["place"] == 1 + sum(x > r["rrf"] for (g, _), x in full.items() if g == r["grp"])
    assert rank_fusion.found(df.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(6)
    items = [(i, rnd.choice([3, 50, 700, 1100, 2048, rnd.randint(1, 2048), rnd.randint(1, 9000)])) for i in range(800)]
    got = packing.pack(spark.createDataFrame(items, "item_id bigint, n_tokens int")).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        parts.setdefault(r["item_id"], []).append((r["start"], r["size"]))
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    for i, n in items:
        p = sorted(parts[i])
        assert sum(s for _, s in p) == n and [a for a, _ in p] == [sum(s for _, s in p[:k]) for k in range(len(p))]
        assert len(p) == -(-n // 2048)
    assert sum(fill.values()) / (2048 * len(fill)) > 0.97
    assert packing.pack(spark.createDataFrame([], "item_id bigint, n_tokens int")).count() == 0


def test_the_bounds_decide_the_batches():
    rnd = random.Random(1)
    hist = np.bincount([rnd.randint(1, 2048) for _ in range(20000)], minlength=2049)
    best = packing.bucket_bounds(hist, 32)
    inside = packing.batch_shapes(hist, best, 2048, fill=False)
    for b, _, shape in inside:  # batches stay in their bucket and keep the padded budget
        lo, hi = best[b - 1] if b else 0, best[b]
        assert all(lo < s <= hi for s in shape) and sum(shape.values()) * hi <= 2048
    even = packing.batch_shapes(hist, list(range(64, 2049, 64)), 2048, fill=False)
    one = packing.batch_shapes(hist, [2048], 2048, fill=False)
    assert packing.fill_of(hist, inside, 2048) >= packing.fill_of(hist, even, 2048) - 0.02 and packing.fill_of(hist, inside, 2048) > packing.fill_of(hist, one, 2048)
    full = {k: packing.batch_shapes(hist, b, 2048) for k, b in (("best", best), ("one", [2048]))}
    assert full["best"] != full["one"]
    assert packing.fill_of(hist, full["best"], 2048) > 0.97
    for shapes in (inside, even, one, *full.values()):
        got = np.zeros_like(hist)
        for _, times, shape in shapes:
            assert sum(s * c for s, c in shape.items()) <= 2048
            for s, c in shape.items():
                got[s] += times * c
        assert (got == hist).all()


def test_violations_are_counted(spark):
    items = spark.createDataFrame([(1, 2000), (2, 3000), (3, 10)], "item_id bigint, n_tokens int")
    good = packing.pack(items)
    assert tuple(packing.violations(items, good).first()) == (3, 0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 0, 1000, 0, 0), (1, 1, 1000, 1000, 0, 1), (2, 0, 0, 2048, 0, 0)], good.schema)
    assert tuple(packing.violations(items, bad).first()) == (2, 1, 1, 2)


def test_many_items_of_one_size(spark):
    got = packing.pack(spark.createDataFrame([(i, 100) for i in range(205)], "item_id bigint, n_tokens int")).groupBy("container").count().collect()
    assert sorted(r["count"] for r in got) == [5] + [20] * 10


def test_bucket_bounds_are_optimal():
    rnd = random.Random(8)
    for _ in range(10):
        hist = np.zeros(13, dtype=int)
        for s in rnd.sample(range(1, 13), 7):
            hist[s] = rnd.randint(1, 9)
        used = [s for s in range(13) if hist[s]]
        pad = lambda bounds: sum(hist[s] * (min(b for b in bounds if b >= s) - s) for s in used)
        best = min(pad((*c, used[-1])) for k in range(3) for c in combinations(used[:-1], k))
        assert pad(packing.bucket_bounds(hist, 3)) == best
    assert packing.bucket_bounds(np.zeros(5, dtype=int), 3) == []


def test_sizes_in_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a " * 30000)], "doc_id bigint, text string")
    got = {r["item_id"]: r["n_tokens"] for r in packing.sizes(docs).collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 10000


# 9 -----------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["a", "b", "c"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 20])))) for i in range(12)] + [(50, None)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(120))) for i in range(15)]
    docs += [(100 + i, "X, " + t.upper().replace(" ", ".\n ") + " y") for i, t in items if t] + [(200, None), (201, ""), (202, "z " * 40000 + items[2][1])]
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leakage.words_of(t)] for k in range(len(w) - 11)}
    want = sorted((d, i) for d, t in docs if t for i, x in items if x and grams(t) & grams(x))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(leakage.leaks(df, it)) == want
    assert rows_of(leakage.leaks(df, it, max_words=30)) == want  # items in blocks
    assert leakage.leaks(df, it.limit(0)).count() == 0 and leakage.leaks(df.limit(0), it).count() == 0


# 10 ----------------------------------------------------------------------------------------------

BAD = [
    "Dear {{ name }}, hello", "Hi ${first_name}", "We at %(company)s hire", "Name: [Your Degree]", "Contact <job title> now", "INSERT CITY HERE", "x __JOB_TITLE__ y", "{% city %}", "Name: &lt;salary&gt;", "(your degree)", "#JOB_TITLE#", "@@phone@@",
    "Lorem ipsum dolor sit amet", "Please enable JavaScript to view this page.", "Please enable\nJavaScript to view this page.", "PLEASE  ENABLE  JAVASCRIPT  TO  VIEW  THIS  PAGE.", "Error 404: the vacancy page you are looking for does not exist.", "403 Forbidden",
    "<div>Lỗi máy chủ nội bộ. Vui lòng thử lại sau.</div>", "Good text here. Too many requests. More text.", "blah blah blah blah", "Vui lòng bật JavaScript để xem trang này.", "Traceback (most recent call last): KeyError: 'x'",
]
GOOD = [
    "Fixed the internal server error that blocked payroll runs.", "Sites that work without JavaScript are a hobby of mine.", "Enabled JavaScript linting in the build.", "Cut the share of 404 and 502 answers on the vacancy site by half.", "Typed { and } all day as a C++ developer, and liked it.",
    "Reached grade <B2> in English & grade <A1> in Korean.", "Salary between [900] and [1200] USD.", "Wrote a rate limiter that answers too many requests politely.", "Replaced placeholder images.", "Đã sửa lỗi máy chủ cho hệ thống tuyển dụng.", "Repaired 403 trucks and 500 trailers in 2019.",
    "Created dummy data for test automation.", "Handled session expiry and access control in the candidate portal.", "Wrote @decorator helpers", "", "  ",
]


def test_residue(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*BAD, *GOOD])] + [(500, None)], "doc_id bigint, text string").withColumn("leaf", F.lit(1))
    got = {r["doc_id"] for r in residue.found(docs).collect()}
    assert {t for i, t in enumerate(BAD) if i not in got} == set()
    assert {t for i, t in enumerate(GOOD, len(BAD)) if i in got} == set()
    assert residue.clean(docs).count() == len(GOOD) + 1
    assert residue.found(docs.limit(0)).count() == 0


def test_a_template_keeps_its_telling_tokens(spark):
    docs = spark.createDataFrame([(1, "Request 137 for Anna was denied at 404."), (2, "Request 99 for Boris was denied at 404."), (3, "Request 99 for Boris was denied at 502."), (4, "Anna likes green tea."), (5, "Boris sells old cars.")], "doc_id bigint, text string")
    t = {r["template"]: (r["support"], r["n_tokens"]) for r in residue.mine_templates(residue.messages(docs)).collect()}
    assert t == {"request # for w was denied w 404.": (2, 8), "request # for w was denied w 502.": (1, 8), "w x 4": (2, 3)}


def test_more_rows_never_take_a_verdict_away(spark):
    alone = ["The site says your session has expired.", "The site says your javascript is required.", "We are sorry but lorem ipsum dolor", "We are sorry but asdf asdf asdf", "Your browser does not support scripts.", "Access denied", "Something went wrong."]
    rnd = random.Random(13)
    company = [" ".join(rnd.sample(a.split(), k=len(a.split()))) for a in alone for _ in range(6)] + [re.sub(r"\w+", lambda m: rnd.choice([m[0], "tea", "7"]), a) for a in alone for _ in range(20)]
    every = [*alone, *company]
    one_by_one = {t for t in every for g in [spark.createDataFrame([(1, t)], "doc_id bigint, text string")] if t in alone and residue.found(g).count()}
    assert one_by_one == set(alone)
    together = {every[r["doc_id"]] for r in residue.found(spark.createDataFrame(list(enumerate(every)), "doc_id bigint, text string")).collect()}
    assert set(alone) <= together


def test_every_match_of_a_pattern_keeps_its_template_and_holds_an_anchor(spark):
    from hypothesis import HealthCheck, given, settings, strategies as st

    cases = []
    for n, (anchors, p) in enumerate(residue.PATTERNS):
        plain = p.replace("\\p{L}\\p{N}", "a-z0-9à-ỹđ").replace("\\p{L}", "a-zà-ỹđ" if "[^\\p{L}" in p else "[a-zà-ỹđ]").replace("[^[a-zà-ỹđ]]", "[^a-zà-ỹđ]")
        seen = set()

        @settings(max_examples=30, database=None, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
        def collect(s):
            seen.add(s)

        given(st.from_regex(plain, fullmatch=True).filter(lambda s: re.fullmatch("[ -~À-ỹ–—’]+", s) and not re.search("[.!?] ", s)))(collect)()
        cases += [(n, s) for s in seen if re.fullmatch(plain, s)]
    df = spark.createDataFrame(cases, "n int, text string").withColumn("templates", residue.templates_of(F.col("text")))
    assert df.select("n").distinct().count() == len(residue.PATTERNS)
    lost = df.filter(F.col("text").rlike(residue.any_of(p for _, p in residue.PATTERNS)) & ~F.exists("templates", lambda t: residue.classify(t).isNotNull()))
    assert [r["text"] for r in lost.collect()] == []


# 4, the table under its name ----------------------------------------------------------------------


def test_component_table_keeps_versions_and_names_by_the_smallest_jd(spark):
    name = f"components-{random.random()}"
    comps = group_split.ComponentTable(spark, name)
    assert comps.load() is None
    first = comps.add(train(spark, [(1, "m", "x", "t", "r", 0, None), (2, "z", "y", "t", "r", 0, None), (3, None, "only", "t", "r", 0, None), (4, None, None, "t", "r", 0, None), (5, " ", "", "t", "r", 0, None)]))
    assert {r["entity"]: r["component"] for r in first.collect()} == {"j:m": "j:m", "c:x": "j:m", "j:z": "j:z", "c:y": "j:z", "c:only": "c:only", "r:4": "r:4", "r:5": "r:5"}
    second = group_split.ComponentTable(spark, name).add(train(spark, [(6, "a", "x", "t", "r", 0, None), (7, "a", "only", "t", "r", 0, None)]))
    assert {r["entity"]: r["component"] for r in second.collect()} == {"j:a": "j:a", "j:m": "j:a", "c:x": "j:a", "c:only": "j:a", "j:z": "j:z", "c:y": "j:z", "r:4": "r:4", "r:5": "r:5"}
    assert rows_of(group_split.found(second)) == [("a", "m")] and comps.versions() == [1, 2]
    states = {r["component"]: (r["n_rows"], r["n_before"], r["state"]) for r in group_split.changes(first, second).collect()}
    assert states["j:a"][:2] == (4, 2) and states["j:a"][2] in ("kept", "quarantined") and states["j:z"] == (1, 1, "kept")
