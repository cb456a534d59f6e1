"""Problem 3: personal information inside free text.

Regular expressions propose spans with their offsets. Each span has a score: a base by its shape,
confirmed or refuted by a checksum (Luhn, mod 97) for long numbers, raised by a label before it ("Tel:",
"Social insurance") and lowered by words that make it something else ("Invoice no.", "parcels"). Spans of
at least ``ACCEPT`` count; weak shapes, such as seven bare digits, only reach it with a label. All of that
runs as built-in expressions inside the JVM, without a shuffle of texts.

Names without a label need a lexicon. It is mined from the corpus: names that stand behind a label
("My name is ...") give first words, and a first word seen with at least ``MIN_PARTNERS`` different
partners enters the lexicon. The lexicon becomes one pattern while it has at most ``PATTERN_WORDS``
words; with a larger one each text gets the same pattern over those of its own words that a join finds,
so that both ways give the same spans.

Redaction cuts by offset; of overlapping spans the one with the higher score, then the longer, then the
earlier is taken. Null texts have no spans and stay null, blank ones come out as they are; repeated rows
give one piece; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.runtime import materialize

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
MIN_PARTNERS, PATTERN_WORDS, ACCEPT = 3, 5000, 0.5

S = r"[\s\x{00A0}]{1,2}"  # white space between the parts of one piece
AT = rf"(?:[\s\x{{00A0}}]{{0,2}}@[\s\x{{00A0}}]{{0,2}}|[\s\x{{00A0}}]{{0,2}}[\[({{]\s?(?i:at)\s?[\])}}][\s\x{{00A0}}]{{0,2}}|{S}(?i:at){S}(?=[\p{{L}}\p{{N}}-]+{S}(?i:dot){S}))"
DOT = rf"(?:\.|[\s\x{{00A0}}]{{0,2}}[\[({{]\s?(?i:dot)\s?[\])}}][\s\x{{00A0}}]{{0,2}}|{S}(?i:dot){S})"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+'-]*{AT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*(?:{DOT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*)+"

#: What every form of AT or the DOT behind a bare "at" has; a text without it holds no address, and looking for it is far cheaper than the pattern.
AT_SIGNS = r"@|[\[({]\s?(?i:at)\s?[\])}]|[\s\x{00A0}](?i:dot)[\s\x{00A0}]"

#: Words before a number that make it a number of something else, and units behind it that do.
NOT_PERSONAL = r"(?:invoice(?:{s}no\.?)?|sku|course|build|version|(?:contract{s})?ref\.?|order(?:{s}no\.?)?|ticket|budget|serial(?:{s}no\.?)?|part(?:{s}no\.?)?|tracking(?:{s}no\.?)?|hoá{s}đơn|đơn{s}hàng)".replace("{s}", S)
UNITS = r"(?:vnd|usd|eur|gbp|đồng|parcels|records|users|tickets|servers|households)"
P = r"[\s\x{00A0}.-]{0,2}"  # between the groups of a phone number
PHONE_SHAPES = (
    rf"\+1{P}\(?\d{{3}}\)?{P}\d{{3}}{P}\d{{4}}",
    rf"(?:\(\+44\)|\+44){P}(?:\(0\){P})?7\d{{3}}{P}\d{{3}}{P}\d{{3}}",
    rf"(?:\(\+84\)|\+84){P}\d{{2,3}}{P}\d{{3}}{P}\d{{3,4}}",
    r"\(?\+(?!1[^\d]|44|84)\d{1,3}\)?([ .-]?)\d{2,4}(?:\2\d{2,4}){1,3}",
    rf"(?:1{P})?\(\d{{3}}\)[\s\x{{00A0}}]{{0,2}}\d{{3}}[\s\x{{00A0}}.-]{{1,2}}\d{{4}}",
    r"(?<!\p{N}[ \x{00A0}(])(?:1[\s\x{00A0}.-]{1,2})?\d{3}[.-]\d{3}[.-]\d{4}",
    r"1[2-9]\d{2}[2-9]\d{6}",
    r"0\d{9,10}",
    r"(?<!\p{N}[ \x{00A0}(])0\d{2,4}[\s\x{00A0}.-]{1,2}\d{3}[\s\x{00A0}.-]{1,2}\d{3,4}",
    r"(?<!\p{N}[ \x{00A0}(])0\d{4}[\s\x{00A0}.-]{1,2}\d{6}",
)
LOOSE_PHONE = (r"\d{3}[ .-]?\d{4}", r"\d{8}")
PHONE = rf"(?=[(+\d])(?<![\p{{L}}\p{{N}}+/.-])(?:{'|'.join((*PHONE_SHAPES, *LOOSE_PHONE))})(?![\p{{L}}\p{{N}}]|[\s\x{{00A0}}./-]\p{{N}})"
DIGIT_IDS = (
    r"\d{3}[\s\x{00A0}-]{1,2}\d{2}[\s\x{00A0}-]{1,2}\d{4}",
    r"\d{3}[\s\x{00A0}]{1,2}\d{3}[\s\x{00A0}]{1,2}\d{3}[\s\x{00A0}]{1,2}\d{3}",
    r"\d{12}",
    r"\d{4}(?:[\s\x{00A0}-]?\d{4}){2}[\s\x{00A0}-]?\d{1,7}",
    r"\d{9}",
)
LETTER_IDS = (
    r"[A-Z][\s\x{00A0}]{0,2}\d{2}[\s\x{00A0}]{0,2}\d{2}[\s\x{00A0}]{0,2}\d{2}[\s\x{00A0}]{0,2}[A-D]",
    r"[A-Z]?\d{7,8}",
    r"[A-Z]\d{2}(?:[\s\x{00A0}]?[A-Z0-9]{4}){3,7}(?:[\s\x{00A0}]?[A-Z0-9]{1,3})?",
)
_END = r"(?![\p{L}\p{N}]|[./-]\p{N})"
DIGIT_ID = rf"(?=\d)(?<![\p{{L}}\p{{N}}+/.-])(?:{'|'.join(DIGIT_IDS)}){_END}"
LETTER_ID = rf"[A-Z](?<![\p{{L}}\p{{N}}+/.-][A-Z])(?:{'|'.join(LETTER_IDS)}){_END}"
#: Labels that speak for a kind, at the end of what stands before a span.
LABELS = {
    "phone": r"tel|telephone|phone|mobile|mob|cell|call|whatsapp|zalo|viber|hotline|fax|sms|điện{s}thoại|đt|sđt|số{s}máy|di{s}động",
    "id_number": r"ssn|social{s}insurance|social{s}security|national{s}insurance|nino|cccd|cmnd|căn{s}cước|passport|hộ{s}chiếu|identity{s}card|national{s}id|iban|mã{s}số{s}thuế|tax{s}id",
}
RAISED = {k: rf"(?<!\p{{L}})(?i:{v.replace('{s}', S)})\.?(?:{S}(?i:no|number|số))?\.?[:#]?[\s\x{{00A0}}]{{0,2}}\(?$" for k, v in LABELS.items()}
LOWERED_BEFORE, LOWERED_AFTER = rf"(?i:{NOT_PERSONAL})[:#]?{S}$", rf"^{S}(?i:{UNITS})\b"
RAISE, LOWER = 0.35, 0.6
NEAR = 40  # characters of context before a span
STREET = r"(?i:street|st|road|rd|avenue|ave|lane|ln|terrace|close|drive|court|place|square|crescent|boulevard|blvd|gardens)"
NOT_STREET = r"(?i:year|day|week|month|hour|minute|million|percent|year-long|lane|way)"
UNIT = r"(?i:flat|unit|apt\.?|apartment|suite|số|nhà|căn[\s\x{00A0}]hộ)"
HOUSE = r"\d{1,4}(?i:[a-d])?(?:[/-]\d{1,4}(?i:[a-d])?)?"
ADDRESS = (
    rf"(?=[\dFUASNCfuasnc])(?<![\p{{L}}\p{{N}}/.,-])(?:{UNIT}{S}{HOUSE},?{S}(?:{HOUSE}{S})?|{HOUSE}{S})(?:"
    rf"(?i:đường|phố|ngõ|hẻm|đại[\s\x{{00A0}}]lộ){S}[\p{{L}}'’-]+{S}[\p{{L}}'’-]+"
    rf"|(?!{NOT_STREET}\b)[\p{{L}}'’-]+(?:{S}(?!{STREET}\b)[\p{{L}}'’-]+)?{S}{STREET}\b(?!{S}(?i:map|depot|retail|pilot)))"
)
TITLE = rf"(?:(?i:mr|ms|mrs|miss|dr|prof|ông|bà|anh|chị)\.?{S})"
CAP = r"(?:\p{Lu}[\p{L}\p{M}'’]+)"
MIDDLE = r"(?i:văn|thị|minh|ngọc|đức|hữu|quang|thanh|xuân|anh|thu|kim|hoàng|gia|bảo)"
NAME = (
    rf"(?:\p{{Lu}}\.[\s\x{{00A0}}]{{0,2}}(?:\p{{Lu}}\.[\s\x{{00A0}}]{{0,2}})?{CAP}(?:-{CAP})?"
    rf"|{CAP}(?:-{CAP})?,{S}{CAP}(?![\p{{L}}])"
    rf"|{CAP}{S}{MIDDLE}{S}{CAP}"
    rf"|{CAP}{S}(?:\p{{Lu}}\.{S})?{CAP}(?:-{CAP})?"
    rf"|(?!(?:the|a|an|my|our|his|her|their|to|for|me|us|you)\b)\p{{Ll}}[\p{{Ll}}\p{{M}}]+{S}(?:{MIDDLE}{S})?\p{{Ll}}[\p{{Ll}}\p{{M}}]+(?:-\p{{Ll}}+)?)"
)
#: What stands before a person's name.
INTRODUCTIONS = (
    "my name is", "full name", "name:", "tôi tên là", "họ và tên", "họ tên", "người liên hệ", "curriculum vitae of", "cv of", "resume of", "candidate:", "applicant:", "ứng viên:",
    "signed", "thank you", "thanks", "regards", "sincerely", "trân trọng", "referee", "reference:", "submitted by", "married to", "reported to", "ask", "contact person", "worked next to",
)


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97_ok(code: str) -> bool:
    s = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in s.upper())) % 97 == 1


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits, inside the JVM."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(chars, lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda acc, d: acc + d - F.when(d > 9, 9).otherwise(0))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """The mod-97 check of an IBAN without spaces, inside the JVM."""
    turned = F.upper(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = F.transform(chars, lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(value, F.lit(0), lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97))
    return rest == 1


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


SPAN = "array<struct<kind:string,start:int,found_text:string,score:double>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, kind: str, pattern: str | Column, base, labelled: bool = False, tail: str = r"[\s\x{00A0}]+$", context: bool = False) -> Column:
    """The accepted spans of a pattern (or of its second group, if ``labelled``), with offsets counted from 0.

    The text is marked at the matches and cut there, so that every piece has its place and both sides of its
    context. ``base`` gives the score of a piece's shape; ``tail`` is cut off a piece's end.
    """
    marks = F.lit("$1\u0001$2\u0002" if labelled else "\u0001$0\u0002")
    marked = F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), marks)
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        return _let(F.split(x, "\u0002"), lambda x: _let(F.regexp_replace(x[0], tail, ""), lambda piece: judged(acc, x[0], x[1], piece)))

    def judged(acc: Column, whole: Column, rest: Column, piece: Column) -> Column:
        score = base(piece) if callable(base) else F.lit(float(base))
        if context:
            after = F.concat(F.substr(whole, F.length(piece) + 1), F.substr(rest, F.lit(1), F.lit(NEAR)))
            score = score + F.when(acc["before"].rlike(RAISED[kind]), RAISE).otherwise(0.0) - F.when(acc["before"].rlike(LOWERED_BEFORE) | after.rlike(LOWERED_AFTER), LOWER).otherwise(0.0)

        def added(score: Column) -> Column:
            one = F.struct(F.lit(kind).alias("kind"), acc["pos"].alias("start"), piece.alias("found_text"), score.alias("score"))
            return F.when(score >= ACCEPT - 1e-9, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])

        out = _let(score, added) if context else added(score)
        before = F.right(F.concat(whole, rest), F.lit(NEAR)) if context else F.lit("")
        return F.struct((acc["pos"] + F.length(whole) + F.length(rest)).alias("pos"), before.alias("before"), out.cast(SPAN).alias("out"))

    def walk(parts: Column) -> Column:
        first = parts[0]
        start = F.struct(F.length(first).alias("pos"), F.right(first, F.lit(NEAR)).alias("before"), none.alias("out"))
        return F.aggregate(F.slice(parts, 2, 1 << 30), start, step)["out"]

    return _let(marked, lambda m: F.when(m.contains("\u0001"), _let(F.split(m, "\u0001"), walk)).otherwise(none))


def _phone_base(piece: Column) -> Column:
    n = F.length(F.regexp_replace(piece, r"\D", ""))
    return F.when(n.between(9, 15), 0.6).when(n.between(7, 8), 0.2).otherwise(0.0)


def _id_base(piece: Column) -> Column:
    """0.9 and 0 for numbers that a checksum confirms or refutes, less for shapes that others share."""
    plain = F.regexp_replace(piece, r"[\s\x{00A0}-]", "")
    n = F.length(plain)
    digits = plain.rlike(r"^\d+$")
    return (
        F.when(digits & (n == 12), F.when(plain.startswith("0"), 0.6).otherwise(0.1)).when(digits & (n > 12), F.when(luhn(plain), 0.9).otherwise(0.0))
        .when(piece.rlike(r"^\d{9}$"), 0.2).when(plain.rlike(r"^[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,}$"), F.when(mod97(plain), 0.9).otherwise(0.0)).otherwise(0.6)
    )


def trie_pattern(words: Iterable[str]) -> str:
    """One alternation over the words, common beginnings shared."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def build(at: dict) -> str:
        parts = sorted((re.escape(c) if c else "") + (build(sub) if sub else "") for c, sub in at.items() if c)
        if "" in at:
            return ("(?:" + "|".join(parts) + ")?") if parts else ""
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return build(tree)


_INTRO = "(?i:" + trie_pattern(INTRODUCTIONS).replace("\\ ", S) + ")[:,]?"
LABELLED = rf"((?<![\p{{L}}\p{{N}}]){_INTRO}{S}{TITLE}?)({NAME})(?![\p{{L}}\p{{N}}@]|\.[\p{{L}}]|[+_-])"
TITLED = rf"((?=[MDP])(?<![\p{{L}}\p{{N}}])(?:Mr|Ms|Mrs|Miss|Dr|Prof)\.?{S})({NAME})(?![\p{{L}}\p{{N}}@])"


def mine_lexicon(names: DataFrame) -> DataFrame:
    """(word): first words of the labelled names (column ``n``) with at least MIN_PARTNERS different partners."""
    n = names.select(F.initcap(F.regexp_replace("n", r"[\s\x{00A0}]+", " ")).alias("n")).distinct()
    straight = n.filter(F.col("n").rlike(rf"^{CAP} (?:\p{{Lu}}\. )?{CAP}(?:-{CAP})?$")).select(F.split("n", " ")[0].alias("word"), F.regexp_extract("n", r"(\S+)$", 1).alias("partner"))
    turned = n.filter(F.col("n").rlike(rf"^{CAP}(?:-{CAP})?, {CAP}$")).select(F.split("n", ", ")[1].alias("word"), F.split("n", ", ")[0].alias("partner"))
    return straight.unionByName(turned).groupBy("word").agg(F.countDistinct("partner").alias("partners")).filter(F.col("partners") >= MIN_PARTNERS).select("word")


def _bare_templates() -> tuple[str, str, str]:
    """The patterns of BareNames, with <one> for the first letters of the words and <words> for the words."""
    end = r"(?![\p{L}\p{N}@_+]|[.-][\p{L}\p{N}])"
    before = r"[\p{L}\p{N}@._+-]"
    gap = r"[ \x{00A0}]{1,2}"
    tail = rf"(?:{gap}\p{{Lu}}\.)?{gap}(?:{MIDDLE}{gap})?{CAP}(?:-{CAP})?"
    # a single character's class comes first: at most places of a text nothing else is tried
    start = rf"<one>(?<!{before}<one>)(?<!\p{{L}},{gap}<one>)(?<=(?=<words>(?!\p{{L}}))<one>)"
    straight = rf"{start}\p{{L}}+{tail}{end}"
    turned = rf"[\p{{Lu}}](?<!{before}\p{{Lu}})(?<!(?=(?i:signed|thanks|regards|sincerely),)\p{{Lu}})[\p{{L}}\p{{M}}'’]+(?:-{CAP})?,{S}<words>(?!\p{{L}}){end}"
    lower = rf"{start}\p{{Ll}}+(?:{gap}{MIDDLE})?{gap}\p{{Ll}}[\p{{Ll}}\p{{M}}'’]+(?:-\p{{Ll}}+)?{end}"
    return straight, turned, lower


class BareNames:
    """Unlabelled names by a lexicon: its words as they are, in upper case, and in lower case before a lower-case word."""

    def __init__(self, words: Iterable[str]):
        words = list(words)
        as_is, low = sorted({x for w in words for x in (w, w.upper())}), sorted({w.lower() for w in words})
        fill = lambda t, ws: t.replace("<one>", "[" + "".join(sorted({w[0] for w in ws})) + "]").replace("<words>", trie_pattern(ws))
        self.patterns = tuple(fill(t, ws) for t, ws in zip(_bare_templates(), (as_is, as_is, low)))

    def of(self, text: Column) -> Column:
        return F.concat(*[_spans(text, "name", p, 0.55) for p in self.patterns])


def proposals(text: Column) -> Column:
    """The spans that need no lexicon."""
    email = F.when(text.rlike(AT_SIGNS), _spans(text, "email", EMAIL, 0.9)).otherwise(F.array().cast(SPAN))
    return F.concat(
        email, _spans(text, "phone", PHONE, _phone_base, tail=r"\D+$", context=True),
        _spans(text, "id_number", DIGIT_ID, _id_base, context=True), _spans(text, "id_number", LETTER_ID, _id_base, context=True),
        _spans(text, "address", ADDRESS, 0.7), _spans(text, "name", LABELLED, 0.8, labelled=True), _spans(text, "name", TITLED, 0.7, labelled=True),
    )


def _filled(template: str, words: Column) -> Column:
    """The template with the words of a row, which are letters, marks and apostrophes; longer ones first."""
    one = F.concat(F.lit("["), F.array_join(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 1))), ""), F.lit("]"))
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    parts = {"<one>": one, "<words>": F.concat(F.lit("(?:"), F.array_join(longest, "|"), F.lit(")"))}
    return F.concat(*[parts.get(x, F.lit(x)) for x in re.split("(<one>|<words>)", template)])


def _bare_by_join(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The spans of unlabelled names for a lexicon too large for a pattern: as BareNames finds them. A word can only stand where its leading letters are a whole run of letters."""
    texts = _keyed(texts)
    lead = F.regexp_extract("word", r"^\p{L}+", 0)
    keys = lexicon.select("word", F.explode(F.array_distinct(F.array(F.lower(lead), F.lower(F.upper(lead))))).alias("k"))
    runs = texts.select("table_name", "row_key", "text_key", F.explode(F.array_distinct(_all(F.lower("text"), r"\p{L}+"))).alias("k"))
    own = runs.join(keys, "k").groupBy(F.col("table_name").alias("t_"), F.col("row_key").alias("k_"), F.col("text_key").alias("x_")).agg(F.collect_set("word").alias("words"))  # bounded by one text
    c = texts.join(own, F.col("table_name").eqNullSafe(F.col("t_")) & F.col("row_key").eqNullSafe(F.col("k_")) & (F.col("text_key") == F.col("x_")))
    as_is = F.array_distinct(F.concat("words", F.transform("words", lambda w: F.upper(w))))
    low = F.array_distinct(F.transform("words", lambda w: F.lower(w)))
    found = F.concat(*[_spans(F.col("text"), "name", _filled(t, ws), 0.55) for t, ws in zip(_bare_templates(), (as_is, as_is, low))])
    return c.select("table_name", "row_key", "text_key", F.explode(found).alias("s")).select("table_name", "row_key", "text_key", "s.*")


def texts_of(train: DataFrame, cv: DataFrame) -> DataFrame:
    return train.select(F.lit("dataset_train").alias("table_name"), F.col("row_id").alias("row_key"), F.col("resume_text").alias("text")).unionByName(
        cv.select(F.lit("cv").alias("table_name"), F.col("rev_id").alias("row_key"), F.col("summary").alias("text"))
    ).filter("text IS NOT NULL")


def _lexicon(names: DataFrame) -> tuple[DataFrame, BareNames | None]:
    """The lexicon as a table, and as patterns while it is small."""
    lexicon = materialize(mine_lexicon(names), "p3-lexicon")
    words = [r["word"] for r in lexicon.limit(PATTERN_WORDS + 1).collect()]
    return lexicon, (BareNames(words) if 0 < len(words) <= PATTERN_WORDS else None)


def spans(texts: DataFrame) -> DataFrame:
    """(table_name, row_key, text_key, kind, start, found_text, score) of every accepted span.

    Two passes over the texts: one for all that has a shape or a label of its own, one for the names that the
    lexicon of the first pass makes known. ``text_key`` tells texts under one key apart.
    """
    keys = ["table_name", "row_key", "text_key"]
    t = _keyed(texts)
    shaped = materialize(t.select(*keys, F.explode(proposals(F.col("text"))).alias("s")).select(*keys, "s.*"), "p3-shaped")
    lexicon, bare = _lexicon(shaped.filter("kind = 'name'").select(F.col("found_text").alias("n")))
    more = _bare_by_join(texts, lexicon) if bare is None else t.select(*keys, F.explode(bare.of(F.col("text"))).alias("s")).select(*keys, "s.*")
    return shaped.unionByName(more)


def _keyed(texts: DataFrame) -> DataFrame:
    """Texts with a key of their own; the two signs that mark spans become blanks, of the same length."""
    return texts.filter("text IS NOT NULL").select("table_name", "row_key", F.xxhash64("text").alias("text_key"), F.translate("text", "\u0001\u0002", "  ").alias("text"))


def find(texts: DataFrame) -> DataFrame:
    """(table_name, row_key, kind, found_text): each distinct piece of each text."""
    return spans(texts).select("table_name", "row_key", "kind", "found_text").distinct()


def _apart(found: Column) -> Column:
    """The spans of one text without overlaps: by score, then length, then place."""
    order = F.transform(found, lambda s: F.struct((-s["score"]).alias("k1"), (-F.length(s["found_text"])).alias("k2"), s["start"].alias("start"), (s["start"] + F.length(s["found_text"])).alias("end"), s["kind"].alias("kind")))
    kept = "array<struct<start:int,end:int,kind:string>>"
    clash = lambda acc, x: F.exists(acc, lambda c: (x["start"] < c["end"]) & (c["start"] < x["end"]))
    one = lambda x: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(F.aggregate(F.array_sort(order), F.array().cast(kept), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, one(x))).cast(kept)))


def redacted(texts: DataFrame) -> DataFrame:
    """(table_name, row_key, text): the whole texts with a typed placeholder at the place of every span."""
    keys = ["table_name", "row_key", "text_key"]
    per_text = spans(texts).groupBy(*keys).agg(F.collect_set(F.struct("kind", "start", "found_text", "score")).alias("found"))  # bounded by one text
    names = F.create_map(*[F.lit(x) for k in KINDS for x in (k, PLACEHOLDERS[k])])
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substr("text", acc["pos"] + 1, s["start"] - acc["pos"]), F.element_at(names, s["kind"])).alias("out"), s["end"].alias("pos"))
    done = F.aggregate(_apart(F.col("found")), F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), step)
    cut = F.transform(F.array(done), lambda d: F.concat(d["out"], F.substr("text", d["pos"] + 1)))[0]
    t = texts.withColumn("text_key", F.xxhash64("text"))
    on = F.col("t.table_name").eqNullSafe(F.col("f.table_name")) & F.col("t.row_key").eqNullSafe(F.col("f.row_key")) & (F.col("t.text_key") == F.col("f.text_key"))
    return t.alias("t").join(per_text.alias("f"), on, "left").select("t.table_name", "t.row_key", "text", "found").select("table_name", "row_key", F.when(F.col("found").isNull(), F.col("text")).otherwise(cut).alias("text"))
