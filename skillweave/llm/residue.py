"""Problem 10: template residue, filler text, error pages and script notices.

Texts are cut into messages (sentences and lines) with numbers as ``#``, and every distinct message of the corpus
goes down a prefix tree of fixed depth: its number of tokens, then its first ``DEPTH`` tokens lead to a leaf. In a
leaf, a message joins the template with which it shares most tokens at the same places, if these are ``SIMILARITY``
of all, or begins a template of its own; where the members of a template differ, it holds ``<*>``.

Only messages with the same telling form share a template: the words that occur in the verdict patterns, signs and
status codes must agree, all other words are ``w``. So a template tells as much as each of its messages, whatever else
the corpus holds: more rows never take a verdict away. A message without any of the patterns' anchor words (each
pattern needs one of its own) tells nothing but its length, so that ordinary messages meet by similarity alone.

Templates are grown in two steps, first from the distinct messages of each partition, then from these candidates by
leaf, so that a hot leaf comes together only as its candidates. The first step depends on how rows are dealt to
partitions, and with it which ordinary words are kept; verdicts do not. Each template is classified once, and the
documents' messages go down the tree again to the templates with a verdict. Unfilled fields inside ordinary records
are found separately, by their delimiters, in the same pass over the texts.

Null and blank texts, empty tables and documents with a null id have no verdict; repeated rows give one;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import eq, itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.runtime import broadcast_if_small, materialize

DEPTH = 3
#: The least share of equal tokens between a message and its template, and what stands where messages differ.
SIMILARITY = 0.5
WILD = "<*>"
LEAF = ("n_tokens", "head", "telling")
HTML_TAG = r"</?(?i:p|div|br|span|li|ul|ol|b|i|em|strong|h[1-6]|td|tr|table|body|html|section|blockquote|pre)(?:\s[^<>]{0,200})?/?>"

#: A field's name, as used between brackets that also occur in ordinary text.
FIELD_WORDS = (
    "name first last full middle title job position role company employer organisation organization city town country state "
    "address street zip phone mobile email salary wage date start end degree skill skills manager hiring recruiter department "
    "university school college number website link url location recipient sender amount reference experience language hobby your my"
).split()
_W = "(?:" + "|".join(sorted(FIELD_WORDS, key=len, reverse=True)) + ")"
FIELD = rf"(?i:{_W}(?:[ _-]?(?:{_W}|\d{{1,2}}))*)"

#: The only signs that a delimited slot can begin with, and the words of the slots without delimiters.
SLOT_START = r"(?=[{$\[<%@#_(])"
INSERTS = ("insert", "INSERT", "Insert")
SLOTS = (
    r"\{\{\s*[\p{L}_][\p{L}\p{N} _.|-]{0,60}\}\}",
    r"\{%-?\s*[\p{L}_][\p{L}\p{N} _.-]{0,60}-?%\}",
    r"\$\{\s*[\p{L}_][\p{L}\p{N} _.-]{0,60}\}",
    r"(?<![{$\p{L}\p{N}])\{[a-z][a-z0-9]{1,30}(?:[_.-][a-z0-9]{1,30}){0,5}\}(?!\})",
    r"\[\[\s*[\p{L}_][\p{L}\p{N} _-]{1,60}\]\]",
    r"<<\s*[\p{L}_][\p{L}\p{N} _-]{1,60}>>",
    r"%\([\p{L}_]\w{1,60}\)[sd]",
    r"%%[\p{L}_]\w{1,60}%%",
    r"@@[\p{L}_]\w{1,60}@@",
    r"#[A-Z][A-Z0-9_]{2,60}#",
    r"(?<!\w)__[A-Z][A-Z0-9_]{1,60}__(?!\w)",
    r"\$[A-Z][A-Z0-9_]{2,60}\$",
    rf"\[\s*{FIELD}\s*\]",
    rf"<\s*{FIELD}\s*>",
    rf"\((?i:your|my|enter)[ _]{FIELD}\)",
)

INSERT_SLOT = r"(?i:\binsert (?:your |the )?[\p{L}\p{N}_]{2,30}(?: [\p{L}\p{N}_]{1,30}){0,4} here\b)"

APOS = "['\u2019]"
_END = r"[^\p{L}]*$"
#: Fixed values: (anchor words, pattern) over messages in lower case; a match holds one of its anchor words. Patterns hold
#: whole words only, since every word in them is a telling token.
ERROR_PAGE = (
    ("error", r"\berror:? (?:code:? )?[45]\d\d\b"),
    ("http", r"\bhttp(?:/[\d#]\.[\d#])? (?:status |error )?[45]\d\d\b"),
    ("found forbidden gateway request unauthorised unauthorized server unavailable requests", r"^(?:[^\p{L}]|\b(?:home|jobs|log in|back to search)\b)*\b[45]\d\d[ :–—-]+(?:page )?(?:not found|forbidden|bad gateway|bad request|unauthorised|unauthorized|internal server error|service (?:temporarily )?unavailable|gateway (?:timeout|time-out|time out)|too many requests)\b"),
    ("requested", r"\brequested (?:url|page|resource) (?:was not|could not be|cannot be) found\b"),
    ("find", rf"\b(?:can{APOS}t|cannot|couldn{APOS}t|could not) find (?:that|the|this) page\b"),
    ("looking", rf"\bpage (?:you are|you{APOS}re|you were) looking for (?:does not|doesn{APOS}t|could not|cannot|no longer|has been)\b"),
    ("working", rf"^(?:this|the) page (?:isn{APOS}t|is not) working\b"),
    ("server", rf"^internal server error{_END}"),
    ("denied", rf"^access (?:is )?denied{_END}"),
    ("permission", rf"\byou (?:don{APOS}t|do not) have permission to (?:access|view)\b"),
    ("gateway", r"\bgateway (?:timeout|time-out|time out):"),
    ("upstream", r"\bupstream server did not respond\b"),
    ("wrong", rf"^(?:oops[^\p{{L}}]+)?something went wrong{_END}"),
    ("available", r"^(?:this|the) (?:listing|page|posting|vacancy|link) is no longer available\b"),
    ("broken", r"\bthe link is broken\.?$"),
    ("limited", r"\byou have been rate limited\b"),
    ("requests", rf"^too many requests{_END}"),
    ("session", r"\byour session (?:has expired|timed out)\b"),
    ("again", r"\bplease log in again to\b"),
    ("checking", r"\bchecking your (?:connection|browser) before\b"),
    ("traceback", r"\btraceback \(most recent call last\)"),
    ("problem", r"\bif the problem continues, contact the site (?:owner|admin|administrator)\b"),
    ("404", r"^404[^\p{L}\p{N}]*$"),
    ("trang", rf"(?<!\p{{L}})không tìm thấy trang{_END}"),
    ("trang", r"(?<!\p{L})trang bạn yêu cầu không tồn tại(?!\p{L})"),
    ("lỗi", r"^(?:[^\p{L}]|\b(?:home|jobs|log in)\b)*lỗi máy chủ nội bộ(?!\p{L})"),
)
SCRIPT_NOTICE = (
    ("javascript js scripts scripting", r"\b(?:enable|turn on|activate) (?:javascript|js|scripts|scripting) (?:to|in|and|then)\b"),
    ("javascript js scripting", r"\b(?:javascript|js|scripting) (?:is|has been) (?:currently )?(?:disabled|turned off|switched off|blocked|required)\b"),
    ("javascript scripts scripting", rf"\bbrowser (?:does not|doesn{APOS}t) support (?:scripting|javascript|scripts)\b"),
    ("javascript scripts", r"\ballow (?:scripts|javascript) in your browser\b"),
    ("javascript scripts scripting", r"\b(?:site|page|app|application) (?:requires|needs) (?:javascript|scripts|scripting)\b"),
    ("noscript", r"\bnoscript:"),
    ("scripting", r"\bwithout client side scripting\b"),
    ("javascript", r"(?<!\p{L})bật javascript (?:để|rồi|và)(?!\p{L})"),
    ("tắt", r"(?<!\p{L})trình duyệt của bạn đã tắt(?!\p{L})"),
    ("tắt", r"(?<!\p{L})đã tắt (?:tập lệnh|javascript)(?!\p{L})"),
)
FILLER = (
    ("lorem", r"\blorem ipsum\b"),
    ("dolor", r"\bdolor sit amet\b"),
    ("enim", r"\but enim ad minim veniam\b"),
    ("consectetur", r"\bconsectetur (?:adipiscing|adipisicing|adipisici)\b"),
    ("nostrud", r"\bquis nostrud exercitation\b"),
    ("dummy sample placeholder filler", r"\bthis is (?:a )?(?:dummy|sample|placeholder|filler) text\b"),
    ("click", r"\bclick here to (?:edit|add|change) (?:this|your) text\b"),
    ("sample dummy placeholder", r"\b(?:sample|dummy|placeholder) text (?:sample|dummy|placeholder) text\b"),
    ("text", r"\byour text (?:goes )?here\b"),
    ("replace", r"\breplace this (?:paragraph|text|section) with\b"),
    ("type", r"\btype your (?:\p{L}+ ){1,6}here\b"),
    ("test", r"\btest test test\b"),
    ("asdf", r"\basdf asdf\b"),
    ("blah", r"\bblah blah blah\b"),
    ("xxx", r"\bxxx xxx xxx\b"),
    ("mẫu", r"(?<!\p{L})(?:nội dung|văn bản) mẫu(?!\p{L})"),
)
KINDS = {"error_page": ERROR_PAGE, "script_notice": SCRIPT_NOTICE, "filler": FILLER}
PATTERNS = tuple(p for pairs in KINDS.values() for p in pairs)


def telling_words() -> list[str]:
    """Every word that stands in a verdict pattern, read off the patterns themselves."""
    bare = (re.sub(r"\\p\{[LN]\}|\\[bdW]|\[[^\]]*\]", " ", p) for _, p in PATTERNS)
    return sorted({w for p in bare for w in re.findall(r"[^\W\d_]+", p)})


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _trie(words: Iterable[str]) -> str:
    """One alternation over the words with common beginnings shared."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def build(at: dict) -> str:
        parts = sorted(c + build(sub) for c, sub in at.items() if c)
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in at else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in at else body

    return build(tree)


#: A word that no pattern holds; "xxxxx" counts as the filler word "xxx".
PARAMETER = rf"(?<![\p{{L}}\p{{M}}])(?!(?:{_trie(telling_words())})(?![\p{{L}}\p{{M}}]))[\p{{L}}\p{{M}}]+"
LONG_X = r"(?<![\p{L}\p{M}])xxx+(?![\p{L}\p{M}])"
NUMBER = r"(?=\p{N})(?<!\p{N})(?![45]\p{N}{2}(?!\p{N}))\p{N}+"
ANCHOR_WORDS = sorted({w for a, _ in PATTERNS for w in a.split()})
ANCHOR = rf"(?=[{''.join(sorted({w[0] for w in ANCHOR_WORDS}))}])(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_trie(ANCHOR_WORDS)})(?![\p{{L}}\p{{M}}\p{{N}}])"
QUOTES = " \"“”'‘’"


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def has_slot(text: Column) -> Column:
    """True if the text holds an unfilled template field."""
    plain = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return plain.rlike(f"{SLOT_START}(?:{any_of(SLOTS)})") | (contains_any(text, INSERTS) & text.rlike(INSERT_SLOT))


def messages_of(text: Column) -> Column:
    """The distinct messages of a text, in lower case with tags as line ends, numbers as ``#`` and single blanks. Hard-wrapped
    texts are also read with their lines joined."""

    def masked(low: Column) -> Column:
        short = F.when(low.contains("xxx"), F.regexp_replace(low, LONG_X, "xxx")).otherwise(low)
        return F.regexp_replace(F.regexp_replace(short, NUMBER, "#"), r"[\p{Z}\t\x0B\f]+", " ")

    def cut(t: Column) -> Column:
        sentence = r" (?<=[.!?] )"
        by_line, joined = F.split(t, rf"[\r\n]+|{sentence}"), F.split(F.regexp_replace(t, r"\s+", " "), sentence)
        return F.when(t.contains("\n") | t.contains("\r"), F.concat(by_line, joined)).otherwise(F.split(t, sentence))

    def trimmed(m: Column) -> Column:
        return F.rtrim(F.ltrim(m, F.lit(QUOTES + ">*•#-")), F.lit(QUOTES))

    plain = F.when(text.contains("<"), F.regexp_replace(text, HTML_TAG, "\n")).otherwise(text)
    # each step's text is bound to a variable, so that it is worked out once
    low = F.transform(F.array(F.lower(plain)), masked)
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(low, cut)), trimmed), lambda m: m != ""))


def n_tokens(message: Column) -> Column:
    return F.length(message) - F.length(F.replace(message, F.lit(" "), F.lit(""))) + 1


def telling_form(message: Column) -> Column:
    """The message with parameters as ``w``; its length alone if it holds no anchor word."""
    form = F.regexp_replace(message, PARAMETER, "w")
    return F.when(message.rlike(ANCHOR), form).otherwise(F.concat(F.lit("w x "), n_tokens(message).cast("string")))


def templates_of(text: Column) -> Column:
    """The distinct telling forms of the messages of a text."""
    return F.array_distinct(F.transform(messages_of(text), telling_form))


def messages(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, messages) of each document with a text and an id."""
    src = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.select("doc_id", has_slot(F.col("text")).alias("slot"), messages_of(F.col("text")).alias("messages"))


def head(message: Column) -> Column:
    """The first ``DEPTH`` tokens, the inner nodes that lead to a leaf among messages of one length."""
    return F.substring_index(message, " ", DEPTH)


def grow(leaf: Iterable[tuple[str, int]], n: int) -> list[tuple[str, int]]:
    """(template, support) from the messages or templates of one leaf, all of n tokens and with the same head."""
    grown: list[list[str]] = []
    supports: list[int] = []
    least = math.ceil(SIMILARITY * n)
    need = least - min(DEPTH, n)  # equal tokens behind the head
    at: list[dict[str, list[int]]] = [defaultdict(list) for _ in range(n)]  # the templates that began with a token at a place
    for template, support in leaf:
        tokens = template.split(" ")
        if need > 0:
            # a template with so many equal tokens is in one of the lists at least, if need - 1 are left out: the longest
            lists = sorted((at[i].get(tokens[i], ()) for i in range(DEPTH, n)), key=len)
            near, plain = set(chain.from_iterable(lists[: len(lists) - need + 1])), [t if t != WILD else None for t in tokens]
            most, best = max(((sum(map(eq, grown[k], plain)), -k) for k in near), default=(0, 0))
        else:
            most, best = (least if grown else 0), 0
        if most < least:
            for i in range(DEPTH, n):
                if tokens[i] != WILD:
                    at[i][tokens[i]].append(len(grown))
            grown.append(tokens)
            supports.append(support)
        else:
            mine = grown[-best]
            for i in range(DEPTH, n):
                if mine[i] != tokens[i]:
                    mine[i] = WILD
            supports[-best] += support
    return [(" ".join(t), k) for t, k in zip(grown, supports, strict=True)]


def grow_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The templates of rows (leaf, template, support) in the order of their leaves; only the templates of one leaf are held
    at a time."""

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["leaf", "template", "support"])

    out = []
    for leaf, members in groupby(rows(), key=itemgetter(0)):
        first, second = next(members), next(members, None)
        if second is None:
            out.append(first)
        else:
            out += [(leaf, *t) for t in grow((r[1:] for r in chain((first, second), members)), int(leaf.split("\n", 1)[0]))]
        if len(out) >= 10_000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def mine_clusters(msgs: DataFrame) -> DataFrame:
    """(n_tokens, head, telling, template, support): the templates in the tree's leaves, with the number of messages (a
    document's equal ones count once)."""
    kind, order = "leaf string, template string, support bigint", ["leaf", F.desc("support"), "template"]
    m = F.col("message")
    distinct = msgs.select(F.explode("messages").alias("message")).groupBy("message").agg(F.count("*").alias("support"))
    leaves = distinct.select(F.concat_ws("\n", n_tokens(m), head(m), telling_form(m)).alias("leaf"), m.alias("template"), "support")  # a message has no line end
    candidates = leaves.sortWithinPartitions(*order).mapInArrow(grow_leaves, kind)
    grown = candidates.repartition("leaf").sortWithinPartitions(*order).mapInArrow(grow_leaves, kind)
    node = F.split("leaf", "\n")
    return grown.select(node[0].cast("int").alias("n_tokens"), node[1].alias("head"), node[2].alias("telling"), "template", "support")


def mine_templates(msgs: DataFrame) -> DataFrame:
    """(n_tokens, template, support): what the mined templates tell, by telling form and with the number of messages."""
    t = mine_clusters(msgs).groupBy(F.col("telling").alias("template")).agg(F.sum("support").alias("support"))
    return t.select(F.size(F.split("template", " ")).alias("n_tokens"), "template", "support")


def classify(template: Column) -> Column:
    """'error_page', 'script_notice', 'filler' or null."""
    out = None
    for kind, pairs in KINDS.items():
        hit = template.rlike(any_of(p for _, p in pairs))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def fits(message: Column, template: Column) -> Column:
    """True if the message has the template's tokens wherever the template holds one."""
    return F.forall(F.zip_with(F.split(template, " "), F.split(message, " "), lambda t, m: (t == m) | (t == WILD)), lambda same: same)


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, kind) of each residue found."""
    msgs = materialize(messages(docs), "p10-messages")
    mined = mine_clusters(msgs).withColumn("kind", classify(F.col("telling"))).filter("kind IS NOT NULL")
    bad = materialize(mined, "p10-verdicts")
    # down the tree again: first to the heads that lead to a verdict, and only there to the leaves and templates; keys that are
    # never null need no null test, which Spark would work out for every message below the first join
    m = F.col("message")
    near = msgs.select("doc_id", F.explode("messages").alias("message")).withColumn("head", F.coalesce(head(m), F.lit(""))).join(broadcast_if_small(bad.select("head").distinct()), "head")
    leaves = near.withColumns({"n_tokens": F.coalesce(n_tokens(m), F.lit(0)), "telling": F.coalesce(telling_form(m), F.lit(""))})
    by_template = leaves.join(broadcast_if_small(bad), list(LEAF)).filter(fits(m, F.col("template"))).select("doc_id", "kind")
    return by_template.unionByName(msgs.filter("slot").select("doc_id", F.lit("unfilled_field").alias("kind"))).distinct()


def found(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The documents without residue, all columns kept. Documents with a null id are kept as well."""
    return docs.join(found(docs).withColumnRenamed("doc_id", "bad_id"), F.col("doc_id").cast("long") == F.col("bad_id"), "left_anti")
