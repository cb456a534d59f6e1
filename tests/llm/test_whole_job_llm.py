"""Queries of the subpackage that once did less than their whole job."""

import random
import re
from itertools import product

from pyspark.sql import functions as F

from skillweave.llm import pii, residue


# residue ------------------------------------------------------------------------------------------


def samples(pattern):
    """Texts of every alternative of a pattern, repeated parts at their least and once more."""
    from re import _parser as sre

    def of(tree):
        parts = []
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(arg)])
            elif op == "NOT_LITERAL":
                parts.append([" "])
            elif op == "IN":
                first = [a for a in arg if str(a[0]) != "NEGATE"][0]
                parts.append([chr(first[1][0]) if str(first[0]) == "RANGE" else chr(first[1]) if str(first[0]) == "LITERAL" else "0" if "DIGIT" in str(first[1]) else " "])
            elif op == "BRANCH":
                parts.append([x for b in arg[1] for x in of(b)])
            elif op == "SUBPATTERN":
                parts.append(of(arg[-1]))
            elif op == "MAX_REPEAT":
                low, high, inner = arg
                parts.append([x * n for n in {low, min(low + 1, int(high))} for x in of(inner)])
            else:
                assert op == "AT" or op.startswith("ASSERT"), op
        return ["".join(x) for x in product(*parts)]  # look-arounds and edges are empty

    return of(sre.parse(pattern.replace(r"[^\p{L}\p{N}]", r"[ ]").replace(r"[^\p{L}]", r"[ ]").replace(r"\p{L}", "q")))


def test_every_alternative_of_a_pattern_holds_an_anchor():
    for anchors, p in residue.PATTERNS:
        plain = p.replace(r"[^\p{L}\p{N}]", r"[\W_]").replace(r"[^\p{L}]", r"[\W\d_]").replace(r"\p{L}", r"[^\W\d_]")
        matches = [x for x in samples(p) if re.search(plain, x)]  # the sampler knows no word edges
        assert matches, p
        for x in matches:
            assert any(re.search(rf"\b{a}\b", x) for a in anchors.split()), (p, x)


def test_spellings_that_share_a_leaf_are_all_found(spark):
    tail = " and then there are a good many further words behind it that fill the line up to the"
    texts = [
        "Your browser does not support JavaScript", "Your browser does not support JavaScript.", "Your browser does not support scripts", "Your browser does not support cookies",
        "Sorry, but the page you are looking for does not exist", "Sorry, but the page you were looking for does not exist",
        "Something that we have not yet told you: enable javascript to go on" + tail + " end", "Something that we have not yet told you: enable javascript to go off" + tail + " stop",
        "<p>Page you are <b>looking</b> <i>for</i> could not be found</p>", "Lorem<br>ipsum", "A good page about ordinary work",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"] for r in residue.found(docs).collect()} == {0, 1, 2, 4, 5, 6, 7, 8, 9}


def test_templates_come_from_the_tree_and_similarity_in_a_leaf(spark):
    texts = [
        "We look for people who are calm today.", "We look for people who are kind today.", "We look for people who were kind today.",
        "We look for staff with seven sharp knives.",  # the same leaf, too few equal tokens
        "They look for people who are calm today.", "We look for people who are calm.",  # another head, another length
        "Request 137 for Anna was denied at 404.", "Request 99 for Boris was denied at 404.", "Request 99 for Boris was denied at 502.",  # codes tell
    ]
    want = {
        "we look for people who <*> <*> today.": 3, "we look for staff with seven sharp knives.": 1, "they look for people who are calm today.": 1, "we look for people who are calm.": 1,
        "request # for <*> was denied at 404.": 2, "request # for boris was denied at 502.": 1,
    }
    for parts in (1, 5):  # in one partition, and as candidates of several
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(parts)
        assert {r["template"]: r["support"] for r in residue.mine_clusters(residue.messages(docs)).collect()} == want


def test_the_search_in_a_leaf_finds_the_most_similar_template():
    rnd = random.Random(1)

    def plain(leaf, n):
        grown = []
        for t, support in leaf:
            tokens = t.split(" ")
            equal = [sum(a == b != residue.WILD for a, b in zip(g, tokens, strict=True)) for g, _ in grown]
            k = max(range(len(grown)), key=lambda i: (equal[i], -i), default=None)
            if k is None or 2 * equal[k] < n:
                grown.append((tokens, support))
            else:
                grown[k] = ([a if a == b else residue.WILD for a, b in zip(grown[k][0], tokens, strict=True)], grown[k][1] + support)
        return [(" ".join(t), k) for t, k in grown]

    for n in [1, 3, 4, 6, 7, 8, 9, 12, 20] * 12:
        words = [f"t{i}" for i in range(rnd.choice([2, 3, 6, 15]))] + [residue.WILD]
        leaf = [(" ".join(["a", "b", "c", *rnd.choices(words, k=max(0, n - 3))][:n]), rnd.randrange(1, 5)) for _ in range(40)]
        assert residue.grow(leaf, n) == plain(leaf, n)


def test_every_message_fits_a_template_that_tells_what_it_tells(spark):
    rnd = random.Random(5)
    words = "your session has expired page not found red tea old cars 404 7 <*> lorem ipsum".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 9, 9, 9]))) for _ in range(1500)]
    msgs = residue.messages(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(6)).cache()
    mined = residue.mine_clusters(msgs).cache()
    m = F.col("message")
    each = msgs.select("doc_id", F.explode("messages").alias("message")).withColumns({"n_tokens": residue.n_tokens(m), "head": residue.head(m), "telling": residue.telling_form(m)})
    fit = each.join(mined, list(residue.LEAF)).filter(residue.fits(m, F.col("template"))).select("doc_id").distinct()
    assert fit.count() == each.select("doc_id").distinct().count() > 0
    assert mined.agg(F.sum("support")).first()[0] == each.count() > mined.count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    alone = docs.filter(F.exists(residue.templates_of(F.col("text")), lambda t: residue.classify(t).isNotNull()) | residue.has_slot(F.col("text")))
    assert {r["doc_id"] for r in residue.found(docs).collect()} == {r["doc_id"] for r in alone.collect()} != set()


# personal information -----------------------------------------------------------------------------


def test_bare_names_are_the_same_by_pattern_and_by_join(spark):
    words = ["Namira", "Mark", "Anna", "O'Neil", "Quỳnh"]
    texts = [
        "Talk to Drollov, Namira. Then rest", "Drollov, Namira\nnext line", "Drollov, Namira went home", "Mark the date, mark drollov and MARK Drollov", "Dear Namira Drollov and Anna Mark Smith",
        "namira văn drollov", "Smith, Anna's desk and Smith, O'Neil here", "Ask Quỳnh Thị Hoa or QUỲNH Nguyen; Namira A. Drollov-Smith", "Xnamira Drollov, anna@x.example", "nothing here", "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string").withColumn("table_name", F.lit("t"))
    a = df.select("row_key", F.explode(pii.BareNames(words).of(F.col("text"))).alias("f")).select("row_key", "f.found_text").collect()
    b = pii._bare_by_join(df, spark.createDataFrame([(w,) for w in words], "word string")).select("row_key", "found_text").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert {(0, "Drollov, Namira"), (1, "Drollov, Namira"), (2, "Drollov, Namira")} <= set(map(tuple, b))
    assert (3, "Mark the") not in set(map(tuple, b))


def test_gates_let_all_forms_of_their_patterns_through(spark):
    mails = ["name@host.example", "name [ at ] host.com", "name {at} host.com", "name (At) host.com", "name AT host DOT com", "name at host\u00a0Dot\u00a0com", "name [AT] host (dot) com"]
    places = ["flat 3, 12 oak street", "Flat 3, 12 Oak Street", "số 12 đường Lê Lợi", "unit 4 12 oak road", "apartment 9, 7 elm lane", "suite 2, 5 elm court", "nhà 12 phố Hàng Bài", "căn hộ 5, 12 đường Lê Lợi"]
    df = spark.createDataFrame([(x, "email") for x in mails] + [(x, "address") for x in places], "x string, kind string").withColumn("text", F.concat(F.lit("Reach me: "), "x", F.lit("; thanks")))
    got = df.select("x", "kind", F.explode(pii.proposals(F.col("text"))).alias("s")).filter("s.kind = kind").select("x", "s.found_text").collect()
    assert sorted(map(tuple, got)) == sorted((x, x) for x in mails + places)
