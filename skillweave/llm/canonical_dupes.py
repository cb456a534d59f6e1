"""Problem 1: records that differ only in formatting.

Every text is brought to a canonical form (characters, case, white space, punctuation, order of
sections), the form is hashed to 128 bits, and copies are counted with map-side combining. A
second, independent 64-bit hash and the form's length travel with the key; they are part of the
grouping, so that a collision of the 128-bit hash would part its records instead of merging them,
and :func:`collisions` reports such keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.llm.words import is_blank, norm_words
from skillweave.runtime import materialize

RESUME_LABELS = ("summary", "experience", "skills", "education", "projects", "languages", "contact")
JD_LABELS = ("title", "about", "duties", "required", "preferred", "location", "benefits")
PAIR_FIELDS = {"resume_text": RESUME_LABELS, "job_description_text": JD_LABELS}
#: A group is hot if it holds over 1 / HOT_SHARE of the rows; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 1000


def canonical_text(text: Column | str, labels: Sequence[str] = ()) -> Column:
    """Words of each section in order, the sections sorted. Text before the first label is a section."""
    words = norm_words(text)
    if not labels:
        return words
    cut = F.regexp_replace(words, rf"(?:^| )({'|'.join(labels)})(?= |$)", "\u0001$1")
    parts = F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s))
    return F.concat_ws("\u0001", F.array_sort(F.array_remove(parts, "")))


def fingerprints(df: DataFrame, id_col: str, fields: Mapping[str, Sequence[str]] = PAIR_FIELDS) -> DataFrame:
    """(row_id, key 16 bytes, check 64 bits, n_chars) of each record whose fields are all filled.

    Records with a null or blank field have no copies and are left out. Other columns are ignored,
    whatever their names; repeated rows count as copies.
    """
    ok = F.lit(True)
    for f in fields:
        ok = ok & ~is_blank(f"`{f}`")
    src = df.filter(ok).select(
        F.col(f"`{id_col}`").alias("row_id"),
        F.concat_ws("\u0002", *[canonical_text(f"`{f}`", labels) for f, labels in fields.items()]).alias("form"),
    )
    return src.select(
        "row_id", F.unhex(F.md5("form")).alias("key"), F.xxhash64("form").alias("check"), F.length("form").alias("n_chars")
    )


def collapse(prints: DataFrame) -> DataFrame:
    """One row per distinct record: (keep_id, copies, key, check, n_chars)."""
    return prints.groupBy("key", "check", "n_chars").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """128-bit keys that stand for more than one canonical form (expected: none)."""
    return groups.groupBy("key").agg(F.count("*").alias("forms")).filter("forms > 1")


def surplus_copies(prints: DataFrame) -> DataFrame:
    """(keep_id, row_id) of each copy but the first. ``prints`` must be cheap to read twice.

    Groups of over a thousandth of the rows, of which there are fewer than a thousand, are joined by
    broadcast; all other groups are small by that bound and join by shuffle.
    """
    groups = materialize(collapse(prints).filter("copies > 1").select("key", "check", "n_chars", "keep_id", "copies"), "p1-groups")
    on = ["key", "check", "n_chars"]
    total = prints.count()
    hot = F.col("copies") * HOT_SHARE > total
    big, small = groups.filter(hot).drop("copies"), groups.filter(~hot).drop("copies")
    out = prints.join(F.broadcast(big), on).unionByName(prints.join(F.broadcast(big.select(on)), on, "left_anti").join(small, on))
    return out.filter("row_id <> keep_id").select("keep_id", "row_id").distinct()


def found(train: DataFrame) -> DataFrame:
    return surplus_copies(materialize(fingerprints(train, "row_id"), "p1-prints"))
