"""Problem 6: freely typed values mapped to a reference list, by a prefix-filter similarity join.

Each distinct value and each form of a reference entry (name, abbreviation, alias) is reduced to sets of
character bigrams: those of its words, and those of its letters without blanks. The bigrams are ordered by
their global rarity, and only the rare prefix of each set is joined. Length and positional filters thin
the candidates out, the Jaccard similarity is verified exactly, a word-wise edit distance decides whether
the value means the entry, and the best entry is kept. Values are made distinct first; rows are only
touched again by the final join.

The threshold loses nothing that :func:`distance` accepts. One edit (a letter put in, left out, changed, or
two swapped) touches at most ``PER_EDIT`` bigrams, so that of a set of d bigrams d - 3k survive k edits
while at most 3k others come in: the overlap is at least d - 3k, hence a shared bigram stands among the
first 3k + 1 of both sets, and the Jaccard similarity is at least (d - 3k) / (d + 3k) (:func:`floor_of`).
Words in another order leave the words' bigrams as they are, other blanks leave the letters' as they are.
Abbreviated words share few bigrams; such a pair has the same initials and an equal word, and is joined by
those.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.words import is_blank
from skillweave.runtime import materialize

UNMATCHED = "unmatched"
PER_EDIT, MOST_EDITS = 3, 3
LEVELS = r"(?:advanced|expert|intermediate|beginner|basic|proficient|fluent|novice|junior|senior|professional level|cơ bản|nâng cao)"
_YEARS = r"\d+(?:[.,]\d+)?\s*\+?\s*(?:years?|yrs?|y|năm)(?:\s+(?:of\s+)?(?:experience|kinh nghiệm))?"
_SUFFIX = re.compile(rf"\s*(?:\(\s*(?:{_YEARS}|{LEVELS})\s*\)|[-–—:/,|]\s*(?:{_YEARS}|{LEVELS})|(?<=\S)\s+{_YEARS}|[*★☆]+)\s*$", re.I)
_PREFIX = re.compile(rf"^\s*(?:{LEVELS}|(?:good |strong |solid |working |basic |deep )?(?:knowledge|command|understanding) of|experienced? (?:in|with)|(?:proficient|skilled|expert) (?:in|with|at)|skills? in|kỹ năng|kinh nghiệm|thành thạo|biết)\s*:?\s+(?=\S)", re.I)
_EDGE = re.compile(r"^[\s\"'“”‘’«»•·*\-–—.,;:_/|()\[\]]+(?=[^\W_])|[\s\"'“”‘’«»•·*\-–—.,;:_/|()\[\]!?]+$")
_WORD = re.compile(r"[^\W_]+[+#]*")


def canonical(value: str) -> str:
    """Lower-case words parted by single spaces, without ratings, years, bullets and quotes; + and # stay."""
    s = unicodedata.normalize("NFKC", value)
    s = re.sub(r"\s+", " ", s).strip().lower()
    for _ in range(4):
        t = _SUFFIX.sub("", s) or s
        t = _EDGE.sub("", t)
        t = _PREFIX.sub("", t)
        if t == s:
            break
        s = t
    return " ".join(_WORD.findall(s))


def bigrams(form: str) -> list[str]:
    out: set[str] = set()
    for w in form.split():
        p = f"^{w}$"
        out.update(p[i : i + 2] for i in range(len(p) - 1))
    return sorted(out)


def edits(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance, or ``limit`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return one[-1]


def abbreviates(short: str, long: str) -> bool:
    """True if ``short`` is ``long`` cut off or with letters left out ('mgmt', 'equip', 'qlty')."""
    if not 2 <= len(short) < len(long) or short[0] != long[0]:
        return False
    if len(short) > 2 and long.startswith(short):
        return True
    rest = iter(long)
    skips_only_vowels = all(c in rest for c in short) and not set(short[1:]) & set("aeiou")
    return skips_only_vowels and len(short) * 2 <= len(long) + 2


def squashed(form: str) -> str:
    return form.replace(" ", "")


def allowance(n: int) -> int:
    return 0 if n <= 3 else 1 if n <= 8 else 2 if n <= 13 else 3


def floor_of(d: int, edits_: int) -> float:
    """The least Jaccard similarity that ``edits_`` edits can leave to a set of d bigrams; small sets need one shared bigram."""
    k = PER_EDIT * edits_
    return (d - k) / (d + k) if d > k else 1.0 / (d + k)


def gram_sets(form: str, slack: int) -> list[dict]:
    """The sets of a form: [{kind, edits, grams}], kind 0 by words, kind 1 without blanks.

    ``slack``: 0 for an entry, whose length decides how many edits it allows; MOST_EDITS for a value, which may
    be that much shorter than the entry it means.
    """
    edits_ = allowance(len(squashed(form)) + slack)
    one = {"kind": 0, "edits": edits_, "grams": bigrams(form)}
    return [one, {"kind": 1, "edits": edits_, "grams": bigrams(squashed(form))}]


def short_keys(form: str) -> list[str]:
    """Keys of which a value and the form it abbreviates word by word share one: initials and an equal word."""
    words = form.split()
    initials = "".join(w[0] for w in words)
    return sorted({f"{initials} {w}" for w in words}) if len(words) > 1 else []


def distance(value: str, form: str) -> float | None:
    """How far ``value`` is from ``form``; None if it doesn't mean it. Equal forms are at 0."""
    if value == form:
        return 0.0
    a, b = value.split(), form.split()
    if sorted(a) == sorted(b):
        return 0.1
    if value.replace(" ", "") == form.replace(" ", ""):
        return 0.2
    if len(a) == len(b) and len(a) > 1 and all(x == y or abbreviates(x, y) for x, y in zip(a, b)) and any(x == y for x, y in zip(a, b)):
        return 0.5
    limit = allowance(len(form.replace(" ", "")))
    d = edits(value, form, limit)
    if d > limit and len(a) == len(b) > 1:
        rest, d = list(b), 0
        for w in a:
            best = min(rest, key=lambda x: edits(w, x, limit))
            d += edits(w, best, min(limit, max(1, len(best) // 3)))
            rest.remove(best)
    if d > limit and len(a) != len(b):
        d = edits(value.replace(" ", ""), form.replace(" ", ""), limit)
    return float(d) if d <= limit else None


SETS = "sets array<struct<kind:int,edits:int,grams:array<string>>>, keys array<string>"


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        form = pdf["value"].map(canonical)
        yield pd.DataFrame({"value": pdf["value"], "form": form, "sets": [gram_sets(x, MOST_EDITS) for x in form], "keys": form.map(short_keys)})


def _ref_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        form = pdf["raw"].map(canonical)
        yield pd.DataFrame({"skill_id": pdf["skill_id"], "form": form, "source": pdf["source"], "sets": [gram_sets(x, 0) for x in form], "keys": form.map(short_keys)})


def reference_forms(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(skill_id, form, source, sets, keys): names, names without bracketed parts, abbreviations, aliases."""
    bare = F.trim(F.regexp_replace("skill_name", r"\s*\([^)]*\)", ""))
    raw = (
        skills.select("skill_id", F.col("skill_name").alias("raw"), F.lit(0).alias("source"))
        .unionByName(skills.select("skill_id", bare.alias("raw"), F.lit(0).alias("source")))
        .unionByName(skills.select("skill_id", F.col("abbreviation").alias("raw"), F.lit(1).alias("source")))
        .unionByName(aliases.select("skill_id", F.col("alias").alias("raw"), F.lit(2).alias("source")))
        .filter("skill_id IS NOT NULL AND raw IS NOT NULL AND raw <> ''")
    )
    f = raw.mapInPandas(_ref_forms, f"skill_id string, form string, source int, {SETS}").filter("form <> ''")
    return f.groupBy("skill_id", "form").agg(F.min("source").alias("source"), F.first("sets").alias("sets"), F.first("keys").alias("keys"))


def _prefix(sets: DataFrame, key: list[str], rarity: DataFrame) -> DataFrame:
    """(key, kind, edits, n, pos, gram) of the rare prefix of each set: what k edits can't all touch, and one more."""
    one = sets.select(*key, F.explode("sets").alias("s")).select(*key, "s.*")
    g = one.select(*key, "kind", "edits", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(rarity, ["kind", "gram"])
    w = Window.partitionBy(*key, "kind").orderBy("df", "gram")  # a set has at most as many rows as its text has letters
    return g.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") <= PER_EDIT * F.col("edits")).drop("df")


def similar(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(form, skill_id, ref_form, source, jaccard): every pair with a set whose Jaccard similarity reaches the entry's floor."""
    every = values.select(F.explode("sets").alias("s")).unionByName(refs.select(F.explode("sets").alias("s")))
    rarity = every.select("s.kind", F.explode("s.grams").alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("df"))
    left = _prefix(values, ["form"], rarity).select("form", "kind", "gram", F.col("n").alias("ln"), F.col("pos").alias("lp"))
    right = _prefix(refs, ["skill_id", "ref_form"], rarity).select("skill_id", "ref_form", "kind", "gram", "edits", F.col("n").alias("rn"), F.col("pos").alias("rp"))
    lost = PER_EDIT * F.col("edits")
    need = F.greatest(F.lit(1), F.col("rn") - lost, F.col("ln") - lost)
    cand = (
        left.join(right, ["kind", "gram"])
        .filter(F.abs(F.col("ln") - F.col("rn")) <= lost)
        .filter(F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) >= need)
        .select("form", "skill_id", "ref_form").distinct()
    )
    both = cand.join(values.select("form", F.col("sets").alias("ls")), "form").join(refs.select("skill_id", "ref_form", "source", F.col("sets").alias("rs")), ["skill_id", "ref_form"])

    def jaccard(i: int):
        a, b = F.col("ls")[i]["grams"], F.col("rs")[i]["grams"]
        inter = F.size(F.array_intersect(a, b))
        return inter / (F.size(a) + F.size(b) - inter)

    def floor(i: int):
        d, k = F.size(F.col("rs")[i]["grams"]), PER_EDIT * F.col("rs")[i]["edits"]
        return F.when(d > k, (d - k) / (d + k)).otherwise(F.lit(1.0) / (d + k))

    j = both.select("form", "skill_id", "ref_form", "source", *[x for i in (0, 1) for x in (jaccard(i).alias(f"j{i}"), floor(i).alias(f"t{i}"))])
    return j.filter((F.col("j0") >= F.col("t0") - 1e-12) | (F.col("j1") >= F.col("t1") - 1e-12)).select("form", "skill_id", "ref_form", "source", F.greatest("j0", "j1").alias("jaccard"))


def abbreviated(values: DataFrame, refs: DataFrame) -> DataFrame:
    """(form, skill_id, ref_form, source) of the pairs with equal initials and an equal word."""
    a, b = values.select("form", F.explode("keys").alias("k")), refs.select("skill_id", "ref_form", "source", F.explode("keys").alias("k"))
    return a.join(b, "k").select("form", "skill_id", "ref_form", "source").distinct()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(dist=[distance(v, f) for v, f in zip(pdf["form"], pdf["ref_form"])])


def map_values(values: DataFrame, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, skill_id) of each distinct value of the column ``value``; 'unmatched' without an entry.

    Null and blank values have no row. Of equally close entries a name goes before an abbreviation
    before an alias, then the more similar one, then the smaller skill_id.
    """
    distinct = values.filter(~is_blank("value")).select("value").distinct()
    formed = materialize(distinct.mapInPandas(_forms, f"value string, form string, {SETS}"), "p6-forms")
    forms = materialize(formed.filter("form <> ''").groupBy("form").agg(F.first("sets").alias("sets"), F.first("keys").alias("keys")), "p6-sets")
    refs = materialize(reference_forms(skills, aliases).withColumnRenamed("form", "ref_form"), "p6-refs")
    pairs = similar(forms, refs).unionByName(abbreviated(forms, refs).withColumn("jaccard", F.lit(0.0)))
    pairs = materialize(pairs.groupBy("form", "skill_id", "ref_form", "source").agg(F.max("jaccard").alias("jaccard")), "p6-pairs")
    # dealt out by number, as the verification costs far more than the few bytes of its rows
    parts = max(values.sparkSession.sparkContext.defaultParallelism, pairs.count() // 20_000)
    scored = pairs.repartition(parts).mapInPandas(_verify, "form string, skill_id string, ref_form string, source int, jaccard double, dist double")
    order = F.struct("dist", "source", (-F.col("jaccard")).alias("nj"), "skill_id")
    best = scored.filter("dist IS NOT NULL").groupBy("form").agg(F.min(order).alias("b")).select("form", F.col("b.skill_id").alias("skill_id"))
    return formed.select("value", "form").join(best, "form", "left").select("value", F.coalesce("skill_id", F.lit(UNMATCHED)).alias("skill_id"))


def found(cv: DataFrame, job: DataFrame, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    def elements(t: DataFrame, name: str) -> DataFrame:
        return t.select(F.lit(name).alias("table_name"), "rev_id", F.explode("skills").alias("skill_value"))

    rows = elements(cv, "cv").unionByName(elements(job, "job")).filter(~is_blank("skill_value")).distinct()
    rows = rows.join(skills.select(F.col("skill_name").alias("skill_value")), "skill_value", "left_anti")
    mapped = materialize(map_values(rows.select(F.col("skill_value").alias("value")), skills, aliases), "p6-map")
    return rows.join(mapped.withColumnRenamed("value", "skill_value"), "skill_value").select("table_name", "rev_id", "skill_value", "skill_id")
