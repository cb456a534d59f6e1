"""Skill spans in token sequences: tiers, windows, relaxed matches and overlap resolution.

The lexer is ours: runs of letters and digits, with 0-based character offsets. A text is read once: its
words walk down a trie of the phrases, and only patterns with enough of their words in the text are tried
as windows. All of that, and the choice between overlapping spans, works inside one text, in Arrow
batches without a shuffle; the patterns are a dictionary of checked size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.runtime import broadcast_if_small

HIT = "doc_id bigint, start int, end int, skill_id string, source string, match string, score double"
# Priority of the sources.
RANK_BY_SOURCE = {"high": 3, "acronym": 2, "low": 1, "token": 0}
RANK_BY_START = {"high": 4, "acronym": 3, "semantic": 3, "low": 2, "token": 1}


#: Patterns are sent to every worker up to this number; more are refused, not cut.
MOST_PATTERNS = 5_000_000
LEXER = re.compile(r"[^\W_]+")


def dictionary_rows(df: DataFrame) -> list:
    """The rows of a pattern table, which must be a dictionary."""
    rows = df.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return rows


class Phrases:
    """A trie over the words of the phrases (skill_id, source, form, case_sensitive); forms of words parted by spaces."""

    def __init__(self, patterns: Iterable[tuple[str, str, str, bool]]):
        self.root: dict = {}
        for sid, source, form, case in patterns:
            at = self.root
            for w in form.lower().split(" "):
                at = at.setdefault(w, {})
            at.setdefault(None, []).append((sid, source, form if case else None))

    def hits(self, words: list[str], low: list[str]) -> set[tuple[int, int, str, str]]:
        """(first word, last word, skill_id, source) of every phrase in the text."""
        out = set()
        for i, w in enumerate(low):
            at, j = self.root.get(w), i
            while at is not None:
                for sid, source, form in at.get(None, ()):
                    if form is None or form == " ".join(words[i : j + 1]):
                        out.add((i, j, sid, source))
                j += 1
                at = at.get(low[j]) if j < len(low) else None
        return out


class Windows:
    """Patterns (skill_id, words) that are matched by ``match(low, words)``; ``least`` says how many of a pattern's
    distinct words a text must hold at all."""

    def __init__(self, patterns: Iterable[tuple[str, list[str]]], match, least):
        self.patterns = {sid: toks for sid, toks in patterns}  # a skill's last form counts
        self.match, self.need, self.by_word = match, {}, {}
        for sid, toks in self.patterns.items():
            self.need[sid] = least(toks)
            for t in set(toks):
                self.by_word.setdefault(t, []).append(sid)

    def hits(self, words: list[str], low: list[str]) -> Iterator[tuple[int, int, str, str, float]]:
        seen: dict[str, int] = {}
        for w in set(low):
            for sid in self.by_word.get(w, ()):
                seen[sid] = seen.get(sid, 0) + 1
        for sid in sorted(s for s, n in seen.items() if n >= self.need[s]):
            for i, j, source, score in self.match(low, self.patterns[sid]):
                yield i, j, sid, source, score


def _read(docs: DataFrame, make, choose=None) -> DataFrame:
    """One pass over the texts: ``make()`` gives the matchers of a worker, ``choose`` picks among a text's spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = make()
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                ms = list(LEXER.finditer(text))
                words = [m[0] for m in ms]
                low = [w.lower() for w in words]
                found = []
                for m in matchers:
                    for i, j, sid, source, *score in m.hits(words, low):
                        s, e = ms[i].start(), ms[j].end()
                        found.append((s, e, sid, source, text[s:e], score[0] if score else 1.0))
                rows += [(d, *f) for f in (choose(found) if choose else found)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "skill_id", "source", "match", "score"])

    return docs.filter("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, HIT)


def tier_hits(docs: DataFrame, patterns: DataFrame, resolved: str | None = None) -> DataFrame:
    """Phrase hits of all tiers: patterns (skill_id, source, form, case_sensitive), forms of words parted by spaces.

    ``resolved``: 'source' or 'start' keeps the spans that :func:`resolve` would, in the same pass.
    """
    return scan(docs, patterns, None, resolved=resolved)


def scan(docs: DataFrame, patterns: DataFrame, forms: list[tuple[str, list[str]]] | None, relax: float = 0.2, resolved: str | None = None) -> DataFrame:
    """Phrases and, with ``forms``, token windows in one pass over the texts."""
    rows = [tuple(r) for r in dictionary_rows(patterns.select("skill_id", "source", "form", "case_sensitive"))]
    shared = docs.sparkSession.sparkContext.broadcast((rows, forms))

    def make():
        tiers, toks = shared.value
        return [Phrases(tiers)] + ([_windows(toks, relax)] if toks is not None else [])

    return _read(docs, make, (lambda found: pick(found, resolved)) if resolved else None)


def _per_text(docs: DataFrame, patterns: list[tuple[str, list[str]]], match, least) -> DataFrame:
    """Runs ``match(words, pattern)`` for every text; patterns are a dictionary."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    return _read(docs, lambda: [Windows(shared.value, match, least)])


def _share(relax: float):
    return lambda toks: ceil((1 - relax) * len(toks))


def _windows(patterns: list[tuple[str, list[str]]], relax: float) -> Windows:
    return Windows(patterns, lambda low, toks: token_window(low, toks, relax), _share(relax))


def token_window(low: list[str], toks: list[str], relax: float = 0.2) -> list[tuple[int, int, str, float]]:
    """Windows of len + floor(relax * len) words holding at least ceil((1 - relax) * len) of the distinct
    words; the last word of a text starts no window; forms of under three words don't count."""
    n = len(toks)
    if n < 3:
        return []
    need, win, want = ceil((1 - relax) * n), n + int(relax * n), set(toks)
    at = [k for k, w in enumerate(low) if w in want]
    out = []
    # only windows that begin at most a window's length before one of the words can hold any
    for i in sorted({i for k in at for i in range(max(0, k - win + 1), k + 1)}):
        if i < max(0, len(low) - 1):
            j = min(len(low), i + win)
            if len({low[k] for k in at[bisect_left(at, i) : bisect_left(at, j)]}) >= need:
                out.append((i, j - 1, "token", 1.0))
    return out


def token_window_all(low: list[str], toks: list[str], relax: float = 0.2) -> list[tuple[int, int, str, float]]:
    """Windows of len + ceil(relax * len) words with all distinct words; the span covers their first places."""
    want = list(dict.fromkeys(toks))
    n = len(want)
    if n <= 2:
        return []
    win = n + ceil(n * relax)
    out = []
    for i in range(max(0, len(low) - n + 1)):
        w = low[i : i + win]
        if all(t in w for t in want):
            at = [i + w.index(t) for t in want]
            out.append((min(at), max(at), "token", 0.5))
    return out


def relaxed_subsequence(low: list[str], toks: list[str], relax: float = 0.2) -> list[tuple[int, int, str, float]]:
    """Words of the form in order from a seed on its first word, within len + ceil(relax * len) places; a
    suffix may be missing. Two-word forms must be whole."""
    n = len(toks)
    if n <= 1:
        return []
    k = ceil(n * relax)
    out = []
    for i, w in enumerate(low):
        if w != toks[0]:
            continue
        p, last = 0, i
        for j in range(i, min(len(low), i + n + k + 1)):
            if p < n and low[j] == toks[p]:
                p, last = p + 1, j
        if (n == 2 and p == 2) or (n > 2 and p >= max(n - k, 2)):
            out.append((i, last, "low", 0.6 + 0.4 * p / n))
    return out


def window_hits(docs: DataFrame, patterns: list[tuple[str, list[str]]], relax: float = 0.2) -> DataFrame:
    return _per_text(docs, patterns, lambda low, toks: token_window(low, toks, relax), _share(relax))


def all_token_hits(docs: DataFrame, patterns: list[tuple[str, list[str]]], relax: float = 0.2) -> DataFrame:
    return _per_text(docs, patterns, lambda low, toks: token_window_all(low, toks, relax), lambda toks: len(set(toks)))


def subsequence_hits(docs: DataFrame, patterns: list[tuple[str, list[str]]], relax: float = 0.2) -> DataFrame:
    return _per_text(docs, patterns, lambda low, toks: relaxed_subsequence(low, toks, relax), lambda toks: 1)


def pick(found: list[tuple], by: str = "source") -> list[tuple]:
    """The greedy choice of :func:`resolve` over one text's (start, end, skill_id, source, match, score)."""
    if by == "source":
        order = lambda f: (-RANK_BY_SOURCE[f[3]], f[0] - f[1], f[0], -f[5], f[2])
    else:
        order = lambda f: (f[0], f[0] - f[1], -RANK_BY_START[f[3]], -f[5], f[2])
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for f in sorted(set(found), key=order):
        at = bisect_right(starts, f[0])  # kept spans are apart, so that only the neighbours can clash
        if (at == 0 or ends[at - 1] <= f[0]) and (at == len(starts) or starts[at] >= f[1]):
            starts.insert(at, f[0])
            ends.insert(at, f[1])
            out.append(f)
    return out


def resolve(hits: DataFrame, by: str = "source") -> DataFrame:
    """Greedy choice of non-overlapping spans per text.

    'source': source rank, then length, descending; 'start': start, then length, rank and score. What is
    still tied goes by start and skill_id, so that the result is fixed.
    """
    table = RANK_BY_SOURCE if by == "source" else RANK_BY_START
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("source"))
    length = F.col("end") - F.col("start")
    keys = [(-rank).alias("k1"), (-length).alias("k2"), F.col("start").alias("k3")] if by == "source" else [F.col("start").alias("k1"), (-length).alias("k2"), (-rank).alias("k3")]
    s = F.struct(*keys, (-F.col("score")).alias("k4"), F.col("skill_id").alias("k5"), "start", "end", "skill_id", "source", "match", "score")
    per = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(s)).alias("h"))
    empty = F.filter("h", lambda x: F.lit(False))
    clash = lambda acc, x: F.exists(acc, lambda c: (x["start"] < c["end"]) & (c["start"] < x["end"]))
    picked = F.aggregate("h", empty, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select("doc_id", F.explode(picked).alias("x")).select("doc_id", "x.start", "x.end", "x.skill_id", "x.source", "x.match", "x.score")


def occurrences(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "skill_id").agg(F.count("*").alias("occurrences"))


def annotation(docs: DataFrame, spans: DataFrame, skills: DataFrame) -> DataFrame:
    """(doc_id, text, results, unique_skills): spans bucketed by source, with skill names and counts."""
    s = spans.join(broadcast_if_small(skills.select("skill_id", "skill_name", "skill_type")), "skill_id")
    item = F.struct("start", "end", "skill_id", "skill_name", "skill_type", "match", "source")
    bucket = lambda c: F.array_sort(F.collect_list(F.when(c, item)))
    high, tok = F.col("source") == "high", F.col("source") == "token"
    res = s.groupBy("doc_id").agg(F.struct(bucket(high).alias("full_matches"), bucket(~high & ~tok).alias("partial_matches"), bucket(tok).alias("token_scanner")).alias("results"))
    cnt = s.groupBy("doc_id", "skill_id", "skill_name", "skill_type").agg(F.count("*").alias("occurrences"))
    uni = cnt.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("skill_id", F.struct("skill_name", "skill_type", "occurrences").alias("v"))))).alias("unique_skills"))
    return docs.select("doc_id", "text").join(res, "doc_id", "left").join(uni, "doc_id", "left")


def training_examples(docs: DataFrame, spans: DataFrame, skills: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON line {"text", "labels": [[start, end, type]]} per text."""
    s = spans.join(broadcast_if_small(skills.select("skill_id", "skill_type")), "skill_id")
    lab = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "skill_type"))).alias("l"))
    text = F.to_json(F.struct("text"))
    labels = F.transform(F.coalesce("l", F.array().cast("array<struct<start:int,end:int,skill_type:string>>")), lambda x: F.concat(F.lit("["), x["start"].cast("string"), F.lit(", "), x["end"].cast("string"), F.lit(', "'), x["skill_type"], F.lit('"]')))
    j = docs.select("doc_id", "text").join(lab, "doc_id", "left")
    return j.select("doc_id", F.concat(F.expr("substring(to_json(struct(text)), 1, length(to_json(struct(text))) - 1)"), F.lit(', "labels": ['), F.array_join(labels, ", "), F.lit("]}")).alias("value"))


ANNOTATION = "array<struct<start:int,end:int,label:string,text:string>>"


def parse_annotations(raw: DataFrame, value: str = "value") -> DataFrame:
    """(doc_id, text, start, end, label, piece) of annotation lines {"text", "labels"}.

    Labels may be [start, end, label] lists, or objects with start, end, label and text; offsets may be
    strings. A line that is no JSON, an unknown shape and a label without offsets give no row.
    """
    j = raw.select("doc_id", F.get_json_object(value, "$.text").alias("text"), F.from_json(F.get_json_object(value, "$.labels"), "array<string>").alias("labels"))
    e = j.select("doc_id", "text", F.explode("labels").alias("l"))
    at = lambda k, i: F.coalesce(F.get_json_object("l", f"$.{k}"), F.get_json_object("l", f"$[{i}]"))
    out = e.select("doc_id", "text", at("start", 0).try_cast("int").alias("start"), at("end", 1).try_cast("int").alias("end"), at("label", 2).alias("label"), at("text", 3).alias("piece"))
    return out.filter("text IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL")


def reanchored(spans: DataFrame, reach: int = 64) -> DataFrame:
    """(doc_id, start, end, label, piece): spans (with text and piece) moved to where their piece stands within
    ``reach`` characters, longest first, spans that overlap a longer one left out. Without a piece the offsets hold.
    """
    own = F.coalesce("piece", F.expr("substring(text, start + 1, end - start)"))
    t = spans.withColumn("piece", own).filter("piece <> ''")
    lo = F.greatest(F.lit(0), F.col("start") - reach)
    near = F.substr("text", lo + 1, F.least(F.length("text"), F.col("end") + reach) - lo)
    fits = F.expr("substring(text, start + 1, length(piece))") == F.col("piece")
    found = F.when(fits, F.col("start")).otherwise(F.when(F.instr(near, F.col("piece")) > 0, lo + F.instr(near, F.col("piece")) - 1))
    t = t.withColumn("start", found.cast("int")).filter("start IS NOT NULL").withColumn("end", (F.col("start") + F.length("piece")).cast("int"))
    s = F.struct((F.col("start") - F.col("end")).alias("k"), "start", "end", "label", "piece")
    per = t.groupBy("doc_id").agg(F.array_sort(F.collect_set(s)).alias("h"))  # bounded by one text
    clash = lambda acc, x: F.exists(acc, lambda c: (x["start"] < c["end"]) & (c["start"] < x["end"]))
    kept = F.aggregate("h", F.filter("h", lambda x: F.lit(False)), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.start", "x.end", "x.label", "x.piece")


def reanchor(text: str, start: int, end: int, piece: str, reach: int = 64) -> tuple[int, int] | None:
    """Where ``piece`` stands within ``reach`` characters of a span whose offsets don't fit."""
    if text[start:end] == piece:
        return start, end
    lo = max(0, start - reach)
    at = text.find(piece, lo, min(len(text), end + reach))
    return (at, at + len(piece)) if at >= 0 and piece else None
