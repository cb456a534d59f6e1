"""Problem 9: evaluation passages inside training text, by Wu-Manber search over words.

Texts are read as sequences of words. Every window of 12 consecutive words of a test item is a
pattern. The search looks at the last block of two words of a window: a shift table says how far
the window can move on without missing a pattern; where the shift is nought, the bucket of the
block's hash holds the patterns that may end here, and a direct comparison of all words decides.

The patterns are broadcast only while the items hold at most ``max_words`` words; a larger item
table is searched in blocks of items of at most that size, one pass each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.runtime import broadcast_if_small

WORD = re.compile(r"[^\W_]+")
WINDOW, BLOCK = 12, 2


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WuManber:
    """Tables over the 12-word windows of the items; all windows have the same length."""

    def __init__(self, items: Iterable[tuple[int, Sequence[str]]], window: int = WINDOW):
        self.window = window
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], set[int]]] = {}
        self.shift: dict[tuple[str, ...], int] = {}
        for item, words in items:
            for i in range(len(words) - window + 1):
                w = tuple(words[i : i + window])
                for end in range(BLOCK, window + 1):
                    b = w[end - BLOCK : end]
                    self.shift[b] = min(self.shift.get(b, window), window - end)
                self.buckets.setdefault(w[-BLOCK:], {}).setdefault(w, set()).add(item)
        self.default = window - BLOCK + 1

    def search(self, words: Sequence[str]) -> set[int]:
        found: set[int] = set()
        shift, default, buckets, m = self.shift, self.default, self.buckets, self.window
        end, n = m, len(words)
        while end <= n:
            block = (words[end - 2], words[end - 1])
            s = shift.get(block, default)
            if s:
                end += s
                continue
            hit = buckets[block].get(tuple(words[end - m : end]))
            if hit:
                found |= hit
            end += 1
        return found


def item_blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most ``max_words`` words (or of one item), streamed to the driver."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for r in items.toLocalIterator():
        w = words_of(r["text"])
        if block and size + len(w) > max_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], w))
        size += len(w)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``window`` consecutive words of the item.

    Null texts hold nothing, items shorter than the window can't leak, repeated rows give one row.
    """
    spark = docs.sparkSession
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    wanted = items.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text")
    for block in item_blocks(wanted, max_words):
        tables = spark.sparkContext.broadcast([(i, " ".join(w)) for i, w in block])

        def scan(batches: Iterator[pd.DataFrame], tables=tables, window=window) -> Iterator[pd.DataFrame]:
            index = WuManber(((i, w.split(" ") if w else []) for i, w in tables.value), window)
            for pdf in batches:
                ids, its = [], []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    for i in index.search(words_of(t)):
                        ids.append(d)
                        its.append(i)
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "item_id": pd.Series(its, dtype="int64")})

        out = out.unionByName(texts.mapInPandas(scan, "doc_id bigint, item_id bigint"))
    return out.distinct()


def report(found: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, split, n_docs, n_sources) of each leaked item."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source").distinct()
    return found.join(src, "doc_id").join(broadcast_if_small(items.select("item_id", "split")), "item_id").groupBy("item_id", "split").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
