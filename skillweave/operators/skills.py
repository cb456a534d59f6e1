"""Skill dictionaries and phrase matching: n-gram equi-joins instead of one huge alternation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skillweave.functions.text import STOP_WORDS, TOKEN, clean_text, ngrams, tokens
from skillweave.runtime import broadcast_if_small, materialize

MOST_ALIASES, MOST_HEADS = 1_000_000, 50_000
#: Of the fuzzy tier: phrases that a task remembers (about 200 MB), texts and new phrases that it takes at once.
MOST_KEPT, FEW_TEXTS, FEW_GRAMS = 1_000_000, 256, 2048
#: A lower-case text without any of these is not changed by clean_text, white space aside.
UNCLEAN = ("<", "@", "://", "www.", "k8s", "golang", "cicd", "ci/cd", "nodejs", "reactjs", "nextjs")
LEX = r"([A-Za-z0-9_]+|[^A-Za-z0-9_])"


def merge_dictionaries(*dicts: DataFrame) -> DataFrame:
    """(canonical, aliases): alias lists of equal names joined in the order given, first spelling kept."""
    rows = None
    for n, d in enumerate(dicts):
        r = d.select(F.col("canonical"), F.lit(n).alias("src"), F.posexplode_outer("aliases").alias("pos", "alias"))
        rows = r if rows is None else rows.unionByName(r)
    rows = rows.withColumn("alias", F.trim(F.regexp_replace(F.coalesce("alias", F.lit("")), r"\s+", " ")))
    first = rows.filter("alias <> ''").groupBy("canonical", F.lower("alias").alias("k")).agg(F.min(F.struct("src", "pos", "alias")).alias("s"))
    lists = first.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["alias"]).alias("aliases"))
    return rows.select("canonical").distinct().join(lists, "canonical", "left").select("canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def alias_table(dictionary: DataFrame) -> DataFrame:
    """(alias, canonical, rank): cleaned aliases with their dictionary order; a shared alias belongs to its last writer."""
    d = dictionary.select("ord", clean_text("canonical").alias("canonical"), F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("pos", "a"))
    d = d.select("canonical", clean_text("a").alias("alias"), F.struct("ord", "pos").alias("at")).filter("alias <> ''")
    return d.groupBy("alias").agg(F.max_by("canonical", "at").alias("canonical"), F.min("at").alias("rank"))


def lex(text: Column) -> Column:
    """Word runs and single other characters, spaces included: joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(LEX), F.lit(1))


def phrase_hits(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, start, length, alias, canonical, rank): every place where an alias stands between word
    boundaries in ``docs`` (doc_id, text, cleaned). The window of each length that occurs in the
    dictionary is joined with the aliases by equality."""
    a = aliases.withColumn("n", F.size(lex(F.col("alias"))))
    lengths = [r["n"] for r in a.select("n").distinct().collect()] or [1]  # bounded by the longest alias
    toks = docs.select("doc_id", lex(F.col("text")).alias("t"))
    heads = [r["h"] for r in a.select(lex(F.col("alias"))[0].alias("h")).distinct().limit(MOST_HEADS + 1).collect()]
    # windows are only made where an alias can begin, as long as the first tokens are few enough to be tested in place
    begins = (lambda w: w.isin(heads)) if len(heads) <= MOST_HEADS else (lambda w: F.lit(True))

    def windows(n: int) -> Column:
        at = F.filter("at", lambda i: i <= F.size("t") - (n - 1))
        return F.transform(at, lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice("t", i, n), "").alias("alias"), F.get("t", i - 2).alias("before"), F.get("t", i + (n - 1)).alias("after")))

    # one pass for all lengths; the generator keeps no array beside its rows
    places = F.transform(F.filter(F.transform("t", lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))), lambda x: begins(x["w"])), lambda x: x["i"])
    toks = toks.select("doc_id", "t", places.alias("at"))
    w = toks.select("doc_id", F.explode(F.concat(*[windows(n) for n in sorted(lengths)])).alias("w")).select("doc_id", "w.*")
    word = lambda c: F.coalesce(F.col(c).rlike("^[A-Za-z0-9_]"), F.lit(False))
    # aliases that begin or end with another sign need a boundary of their own
    h = w.join(broadcast_if_small(a.withColumnRenamed("n", "length")), ["alias", "length"]).filter(~word("before") & ~word("after"))
    return h.select("doc_id", "start", "length", "alias", "canonical", "rank")


def leftmost(hits: DataFrame) -> DataFrame:
    """Non-overlapping hits as a scan from the left would take them; at one place the earlier alias wins."""
    s = F.struct("start", "rank", "length", "alias", "canonical")
    per = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(s)).alias("h"))  # bounded by one text
    init = F.struct(F.lit(0).alias("end"), F.array().cast(hits.select(F.array(s).alias("x")).schema["x"].dataType).alias("out"))
    step = lambda acc, x: F.when(x["start"] >= acc["end"], F.struct((x["start"] + x["length"]).alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    return per.select("doc_id", F.explode(F.aggregate("h", init, step)["out"]).alias("x")).select("doc_id", "x.*")


@dataclass(frozen=True)
class FuzzyTier:
    """The second tier of an extraction: phrases near a skill's vector. Without an encoder there is none."""

    embedder: object
    at_least: float = 0.70
    max_words: int = 4
    #: Of each text, so many candidates in order are looked up; this bound is part of the operator.
    first: int = 500


def known_aliases(aliases: DataFrame) -> list[str]:
    """All aliases; a dictionary of more than ``MOST_ALIASES`` is an error."""
    known = [r["alias"] for r in aliases.select("alias").distinct().limit(MOST_ALIASES + 1).collect()]
    if len(known) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    return known


def candidate_lengths(max_words: int) -> list[int]:
    return sorted({1, 2, 3, max(1, min(max_words, 4))})


def candidates(docs: DataFrame, aliases: DataFrame, max_words: int = 4, first: int = 500) -> DataFrame:
    """(doc_id, pos, gram): the different n-grams of a text's tokens (shortest n first, then by place) of 2 to 64
    characters that are no alias, up to ``first`` of them. The aliases are a dictionary of checked size."""
    known = known_aliases(aliases)
    t = docs.select("doc_id", tokens("text").alias("t"))
    grams = F.array_distinct(F.concat(*[ngrams("t", n) for n in candidate_lengths(max_words)]))
    good = F.filter(grams, lambda g: F.length(g).between(2, 64) & ~g.isin(known))
    return t.select("doc_id", F.posexplode(F.slice(good, 1, first)).alias("pos", "gram"))


def candidate_list(toks: list[str], known: set[str], lengths: list[int], first: int) -> list[str]:
    """The candidates of one text, as ``candidates`` has them."""
    out: list[str] = []
    for n in lengths:  # tokens hold no space, so that phrases of different lengths differ
        grams = dict.fromkeys(toks if n == 1 else map(" ".join, zip(*(toks[i:] for i in range(n)))))
        out += [g for g in grams if 2 <= len(g) <= 64 and g not in known]
        if len(out) >= first:
            break
    return out[:first]


def nearest(v: np.ndarray, mean: np.ndarray, at_least: float, block: int) -> np.ndarray:
    """For each row of ``v`` the row of ``mean`` with the largest product, the first of equals, or -1 if it is too small.

    Products in single precision tell which rows can reach ``at_least``; their error is at most the slack."""
    out = np.full(len(v), -1, dtype=np.int64)
    size = float(np.sqrt((v * v).sum(1).max(initial=0)) * np.sqrt((mean * mean).sum(1).max(initial=0)))
    slack = 1e-8 + 4 * (v.shape[1] + 3) * 2.0**-24 * size
    rough = np.full(len(v), -np.inf, dtype=np.float32)
    single = v.astype(np.float32)
    for k in range(0, len(mean), block):
        np.maximum(rough, (single @ mean[k : k + block].T.astype(np.float32)).max(1), out=rough)
    able = np.flatnonzero(rough >= at_least - slack)
    if len(able):
        out[able] = exact_nearest(v[able], mean, at_least, block)
    return out


def exact_nearest(v: np.ndarray, mean: np.ndarray, at_least: float, block: int) -> np.ndarray:
    best, where = np.full(len(v), -np.inf), np.zeros(len(v), dtype=np.int64)
    for k in range(0, len(mean), block):
        s = np.round(v @ mean[k : k + block].T, 9)
        i = s.argmax(1)
        top = s[np.arange(len(v)), i]
        where, best = np.where(top > best, k + i, where), np.maximum(top, best)
    return np.where(best >= at_least, where, -1)


def cleaned_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, toks): the same as ``tokens``, joined by a space. Texts that are clean already are not cleaned again,
    which costs more than all else."""
    t = docs.select("doc_id", "text", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    unclean = reduce(lambda a, b: a | b, [F.col("low").contains(x) for x in UNCLEAN])
    found = F.regexp_extract_all(F.when(unclean, clean_text("text")).otherwise(F.col("low")), F.lit(f"({TOKEN})"), F.lit(1))
    return t.select("doc_id", F.array_join(F.filter(found, lambda w: ~w.isin(STOP_WORDS)), " ").alias("toks"))


def fuzzy(docs: DataFrame, aliases: DataFrame, tier: FuzzyTier, block: int = 4096, kept: int = MOST_KEPT) -> DataFrame:
    """(doc_id, canonical): the skills nearest to the candidates of each text, if near enough. A skill's vector is the
    mean of its aliases' vectors.

    A text has hundreds of candidates and seldom one that is near, so that they are made where they are encoded and
    only what is found leaves the task. A task encodes each different candidate once, as long as it has no more than
    ``kept`` of them; beyond that it forgets what it knows and may encode one again."""
    known = set(known_aliases(aliases))
    own = aliases.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("a")).orderBy("canonical").collect()  # bounded by known_aliases()
    if not own:
        return docs.select("doc_id", F.lit("").alias("canonical")).limit(0)
    names = [r["canonical"] for r in own]
    mean = np.stack([np.mean(np.asarray(tier.embedder.encode(list(r["a"])), dtype=np.float64), axis=0) for r in own])
    shared = docs.sparkSession.sparkContext.broadcast((names, mean, known))
    encoder, at_least, first, lengths = tier.embedder, tier.at_least, tier.first, candidate_lengths(tier.max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mean, known = shared.value
        near: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, FEW_TEXTS):
                part = batch.slice(k, FEW_TEXTS)
                grams = [candidate_list(t.split(" "), known, lengths, first) for t in part.column("toks").to_pylist()]
                if len(near) > kept:
                    near.clear()
                new = list(dict.fromkeys(g for of in grams for g in of if g not in near))
                for j in range(0, len(new), FEW_GRAMS):
                    some = new[j : j + FEW_GRAMS]
                    near.update(zip(some, nearest(np.asarray(encoder.encode(some), dtype=np.float64), mean, at_least, block).tolist()))
                hits = [(r, i) for r, of in enumerate(grams) for i in {near[g] for g in of} if i >= 0]
                if hits:
                    ids = part.column("doc_id").take(pa.array([r for r, _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([names[i] for _, i in hits], pa.string())], ["doc_id", "canonical"])

    schema = StructType([docs.schema["doc_id"], StructField("canonical", StringType())])
    return cleaned_tokens(docs).mapInArrow(run, schema).distinct()


def extract(docs: DataFrame, aliases: DataFrame, tier: FuzzyTier | None = None) -> DataFrame:
    """(doc_id, skills): the sorted set of canonical names found in each text; every doc_id has a row.

    Aliases are matched as phrases; with a ``tier``, phrases near a skill's vector count as well."""
    if tier is not None:
        docs = materialize(docs.select("doc_id", "text"), "fuzzy-docs")  # both tiers read the cleaned texts
    hits = leftmost(phrase_hits(docs, aliases)).select("doc_id", "canonical")
    if tier is not None:
        hits = hits.unionByName(fuzzy(docs, aliases, tier))
    found = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("canonical")).alias("skills"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def coverage(hit: Column, wanted: Column, a: float = 1.0, b: float = 1.0) -> Column:
    """Laplace-smoothed share of the wanted skills that are there; 0 without wanted skills."""
    return F.when(F.size(wanted) == 0, 0.0).otherwise((F.size(F.array_intersect(hit, wanted)) + a) / (F.size(wanted) + a + b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))


def mine_phrases(texts: DataFrame, exclude: DataFrame, blacklist: tuple[str, ...] = ("c", "r", "go", "net", "ai", "ml"), max_n: int = 4, min_freq: int = 3) -> DataFrame:
    """(phrase, freq): n-grams of the column ``text`` that are no known alias, no number and frequent enough."""
    word = r"([a-zA-ZÀ-ỹ0-9+#.\-]{2,})"
    t = texts.select(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(1)).alias("t"))
    grams = t.select(F.explode(F.concat(*[ngrams("t", n) for n in range(1, max_n + 1)])).alias("phrase"))
    counted = grams.groupBy("phrase").agg(F.count("*").alias("freq")).filter(F.col("freq") >= min_freq)
    ok = (F.length("phrase") > 2) & ~F.col("phrase").isin(*blacklist) & ~F.col("phrase").rlike(r"^[0-9.]+$")
    return counted.filter(ok).join(exclude.select(F.lower("alias").alias("phrase")).distinct(), "phrase", "left_anti")
