"""Scalar text functions, as column expressions where Spark has the parts, else as Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Results depend on exactly these words.
STOP_WORDS = """
the a an and or in on for of to with at as by is are was were
be been being this that these those from into within via using use it
we you they our their your i he she his her them me my us also
responsible responsibilities experienced experience experiences familiar knowledge
skills skill ability abilities proficient expert strong good excellent great
working work worked team teams environment environments company companies
project projects role roles tasks task duties duty objective objectives
summary description descriptions requirement requirements preferred plus nice
including etc etc. eg e.g ie i.e based per performs perform performing
developing develop developed build building built design designing designed
implement implementation implemented maintain maintaining maintained support
supporting supported lead leading led manage managing managed mentor mentoring
coordinate coordinating coordinated collaborate collaboration collaborated
degree bachelor master phd university college certification certificate
junior senior intern internship full-time part-time contract freelance remote
monday tuesday wednesday thursday friday saturday sunday
january february march april may june july august september october november december
jan feb mar apr jun jul aug sep sept oct nov dec year years month months
""".split()

# Spellings brought to one form. Rules that put back what they match are left out.
SPELLINGS = (
    (r"\bk8s\b", "kubernetes"),
    (r"\bgolang\b", "go"),
    (r"\bci/?cd\b", "ci cd"),
    (r"\bnode\.?js\b", "node.js"),
    (r"\breact\.?js\b", "react.js"),
    (r"\bnext\.?js\b", "next.js"),
)
TAG, URL = r"<[^>]+>", r"(?i)https?://\S+|www\.\S+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TOKEN = r"[a-z0-9][a-z0-9+._/#-]*"
# Letters whose presence marks a text as Vietnamese.
VIETNAMESE_LETTERS = "ăâêôơưđáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def collapse(x: Column | str) -> Column:
    """White space runs become one space, ends trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(_or_empty(x), _SPACE, " "))


def norm_text(x: Column | str) -> Column:
    return collapse(F.lower(_or_empty(x)))


def clean_text(x: Column | str) -> Column:
    """Tags, links and addresses out, white space collapsed, lower case, spellings unified."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(_or_empty(x), TAG, " "), URL, " "), EMAIL, " ")
    s = F.lower(collapse(s))
    for pattern, to in SPELLINGS:
        s = F.regexp_replace(s, pattern, to)
    return s


def all_tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(clean_text(x), F.lit(f"({TOKEN})"), F.lit(1))


def tokens(x: Column | str, stop: list[str] | None = None) -> Column:
    """Tokens of the cleaned text without stop words, in order, with repeats."""
    stop = STOP_WORDS if stop is None else stop
    return F.filter(all_tokens(x), lambda t: ~t.isin(stop)) if stop else all_tokens(x)


def ngrams(toks: Column | str, n: int) -> Column:
    """The n-grams of an array of tokens, joined by a space."""
    t = _c(toks)
    if n == 1:
        return t
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))


@F.pandas_udf(StringType())
def _clean_html(s: pd.Series) -> pd.Series:
    def one(t: str | None) -> str:
        t = unicodedata.normalize("NFKC", html.unescape(t or ""))
        t = "".join(c for c in t if c in "\n\t" or unicodedata.category(c)[0] != "C")
        return t

    return s.map(one)


def clean_html(x: Column | str) -> Column:
    """clean_text after unescaping entities, NFKC and dropping control characters."""
    return clean_text(_clean_html(_c(x)))


def normalize_text(x: Column | str) -> Column:
    """Lower case, bracketed parts out, only word characters and + # . - kept."""
    s = F.regexp_replace(F.lower(_or_empty(x)), r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    return collapse(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}_\s+#.-]", " "))


def clean_label(x: Column | str, depth: int = 3) -> Column:
    """Lower case, bracket blocks stripped (nested up to ``depth``), other signs become spaces."""
    s = F.lower(_or_empty(x))
    for _ in range(depth):
        s = F.regexp_replace(s, r"\([^()]*\)|\[[^\[\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s]+", " "), r"\s+", " "))


def abbreviation(x: Column | str) -> Column:
    """The first bracketed part if it is written in capitals, digits and hyphens, else ''."""
    inner = F.trim(F.regexp_extract(_or_empty(x), r"\(([^)]*)\)", 1))
    return F.when(inner.rlike(r"^[A-Z0-9-]+$"), inner).otherwise("")


def sub_forms(x: Column | str) -> Column:
    """Acronyms of two or more capitals, parted alike by nothing, '&' or '.'."""
    bare = F.regexp_replace(_or_empty(x), r"[(\[].*?[)\]]", "")
    return F.regexp_extract_all(bare, F.lit(r"(\b[A-Z](?=([&.]?))(?:\2[A-Z])+\b)"), F.lit(1))


def ascii_clean(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_or_empty(x), r"[^\x00-\x7F]+", " "), r"\s+", " "))


def is_acronym(x: Column | str) -> Column:
    """At least two letters, all of them capitals."""
    letters = F.regexp_replace(_or_empty(x), r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & (letters == F.upper(letters)) & ~letters.rlike(r"[^\p{Lu}]")


def is_safe_abbreviation(x: Column | str) -> Column:
    return (F.length(_or_empty(x)) >= 3) & is_acronym(x)


def is_ascii_english(x: Column | str) -> Column:
    """Only ASCII, and longer than two characters or one of c#, c++, go."""
    t = F.lower(F.trim(_or_empty(x)))
    return ~t.rlike(r"[^\x00-\x7F]") & ((F.length(t) > 2) | t.isin("c#", "c++", "go"))


def looks_vietnamese(x: Column | str) -> Column:
    return F.lower(_or_empty(x)).rlike(f"[{VIETNAMESE_LETTERS}]")


def _accents() -> tuple[str, str]:
    """Letters of Latin scripts whose decomposition is a base letter and marks, with their bases."""
    src, dst = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in d if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, BASES = _accents()


def strip_accents(x: Column | str) -> Column:
    """Marks off Latin letters, composed or decomposed ('đ' has no decomposition and stays)."""
    return F.regexp_replace(F.translate(_or_empty(x), ACCENTED, BASES), r"\p{Mn}", "")


def slugify(x: Column | str) -> Column:
    """ASCII slug with underscores; 'unknown' if nothing is left. 'đ' reads as 'd'."""
    s = F.lower(F.translate(strip_accents(x), "đĐ", "dD"))
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def plain_tokens(x: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(_or_empty(x)), r"[^a-z0-9]+"), lambda t: t != "")


def comma_list(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_or_empty(x), ","), lambda t: F.trim(t)), lambda t: t != "")


def label_parts(x: Column | str, min_len: int = 2) -> Column:
    """Parts between line breaks (real or written), collapsed, long enough, first of each spelling."""
    parts = F.transform(F.split(_or_empty(x), r"\r?\n|\\n"), lambda p: collapse(p))
    return unique_ci(F.filter(parts, lambda p: F.length(p) >= min_len))


def unique_ci(arr: Column) -> Column:
    """First occurrence of each element, compared without case, in order."""
    return F.aggregate(
        arr, F.array().cast("array<string>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))),
    )


def merge_jd(requirement: Column | str, description: Column | str) -> Column:
    """Both parts trimmed and joined by an empty line; one of them if the other is blank; else ''."""
    a, b = F.trim(_or_empty(requirement)), F.trim(_or_empty(description))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("\n\n"), b)).otherwise(F.concat(a, b))


def ratio(a: str, b: str) -> float:
    import difflib

    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, for which Spark has no function."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def porter(word: str) -> str:
    """The Porter (1980) stemmer, after the published steps."""
    w = word.lower()
    if len(w) <= 2:
        return w

    def cons(i: int, s: str) -> bool:
        return s[i] not in "aeiou" and (s[i] != "y" or i == 0 or not cons(i - 1, s))

    def m(s: str) -> int:
        f = "".join("c" if cons(i, s) else "v" for i in range(len(s)))
        return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", f)))

    def vowel(s: str) -> bool:
        return any(not cons(i, s) for i in range(len(s)))

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and cons(len(s) - 1, s)

    def cvc(s: str) -> bool:
        n = len(s)
        return n > 2 and cons(n - 3, s) and not cons(n - 2, s) and cons(n - 1, s) and s[-1] not in "wxy"

    def first(s: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
        for end, to in rules:
            if s.endswith(end):
                stem = s[: len(s) - len(end)]
                return stem + to if m(stem) > least else s
        return s

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = first(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = first(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(end):
            stem = w[: len(w) - (3 if end in ("sion", "tion") else len(end))]
            if m(stem) > 1:
                w = stem
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(s: pd.Series) -> pd.Series:
    """Each space-separated token stemmed."""
    return s.map(lambda t: " ".join(porter(w) for w in (t or "").split()))


def lemma(x: Column, lemmas: dict[str, str]) -> Column:
    """Each token replaced by its lemma from a pluggable map."""
    table = F.create_map(*[F.lit(v) for kv in lemmas.items() for v in kv]) if lemmas else None
    toks = F.split(collapse(x), " ")
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.element_at(table, t), t)) if lemmas else toks, " ")
