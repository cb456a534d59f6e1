"""Problem 8: items of varying length packed into containers of fixed capacity.

Sizes are counted in tokens of a public tokenizer (its file is a parameter). The global histogram of
the sizes, one counter per size up to the capacity, is all that reaches the driver. Dynamic programming
over it chooses the bucket boundaries that minimise padding. Token-budget batches form inside each
bucket (:func:`bucket_batches`); in a second step the room they leave is topped up with smaller items
(:func:`top_up`), all in the histogram. Items are numbered within their size by a distributed count and
take their places by number.

Items larger than the capacity are cut into full containers and a remainder that is packed like an item.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
CAPACITY = 2048


def token_counter(path: str = TOKENIZER):
    """text -> number of tokens; loads the vocabulary where it runs."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(item_id, n_tokens); null and empty texts have no tokens and are left out of the packing.

    The vocabulary file is read on the driver and goes to the executors with the job."""
    sc = docs.sparkSession.sparkContext
    sc.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(SparkFiles.get(name))
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "n_tokens": [count(t) for t in pdf["text"]]})

    src = docs.filter(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInPandas(run, "item_id bigint, n_tokens int").filter("n_tokens > 0")


def pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item_id, part, start, size): one piece per item, more only for items above the capacity."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    p = items.select("item_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    start = F.col("part") * capacity
    return p.select("item_id", "part", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("size"))


def bucket_bounds(hist: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding (hist[s] = items of size s).

    Padding of a bucket (lo, hi] is the sum of hi - s over its items. Optimal, by dynamic programming.
    """
    used = np.flatnonzero(hist)
    if not len(used):
        return []
    n = len(used)
    cnt = np.concatenate(([0], np.cumsum(hist[used]))).astype(np.float64)
    tok = np.concatenate(([0], np.cumsum(hist[used] * used))).astype(np.float64)
    k = min(buckets, n)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((k + 1, n + 1), dtype=np.int64)
    for b in range(1, k + 1):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + used[j - 1] * (cnt[j] - cnt[:j]) - (tok[j] - tok[:j])
            i = int(np.argmin(cost))
            new[j], back[b, j] = cost[i], i
        best = new
    out, j = [], n
    for b in range(k, 0, -1):
        if j == 0:
            break
        out.append(int(used[j - 1]))
        j = back[b, j]
    return sorted(set(out))


def bucket_batches(left: np.ndarray, lo: int, hi: int, capacity: int) -> dict[int, int]:
    """One token-budget batch of the bucket (lo, hi]: {size: items}, the largest first.

    The budget counts every item at the bucket's bound, as if padded to it, so that the batch takes
    capacity // hi items; the bounds decide what stands together.
    """
    shape: dict[int, int] = {}
    places = capacity // hi
    for s in (np.flatnonzero(left[lo + 1 : hi + 1]) + lo + 1)[::-1]:
        if not places:
            break
        shape[int(s)] = take = int(min(left[s], places))
        places -= take
    return shape


def top_up(shape: dict[int, int], left: np.ndarray, room: int, hi: int) -> dict[int, int]:
    """The batch with its unused room filled: the largest sizes up to ``hi`` that still fit."""
    out, s = dict(shape), hi
    while room > 0 and s > 0:
        avail = np.flatnonzero(left[1 : min(s, room) + 1])
        if not len(avail):
            break
        s = int(avail[-1]) + 1
        take = int(min(left[s] - out.get(s, 0), room // s))
        if take > 0:
            out[s] = out.get(s, 0) + take
            room -= take * s
        s -= 1
    return out


def batch_shapes(hist: np.ndarray, bounds: list[int], capacity: int, fill: bool = True) -> list[tuple[int, int, dict[int, int]]]:
    """[(bucket, containers, {size: items in each})], bucket by bucket from the top.

    Batches form inside each bucket; with ``fill`` the room that padding and the last places of a batch
    leave is topped up from the same and the lower buckets in a second step.
    """
    left = hist.astype(np.int64).copy()
    shapes: list[tuple[int, int, dict[int, int]]] = []
    for b in range(len(bounds) - 1, -1, -1):
        lo, hi = (bounds[b - 1] if b else 0), bounds[b]
        while shape := bucket_batches(left, lo, hi, capacity):
            if fill:
                shape = top_up(shape, left, capacity - sum(s * c for s, c in shape.items()), hi)
            times = int(min(left[s] // c for s, c in shape.items()))
            for s, c in shape.items():
                left[s] -= times * c
            shapes.append((b, times, shape))
    return shapes


def fill_of(hist: np.ndarray, shapes: list[tuple[int, int, dict[int, int]]], capacity: int) -> float:
    """The share of the containers' room that is used."""
    n = sum(times for _, times, _ in shapes)
    return float((hist * np.arange(len(hist))).sum() / (n * capacity)) if n else 1.0


def numbered(p: DataFrame, blocks: int = 64) -> DataFrame:
    """Adds ``nr``: 0, 1, 2, ... within each size. Counted in hash blocks, so that a size that most items share is no single task."""
    h = p.withColumn("block", F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)))
    counts = h.groupBy("size", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "block").orderBy("item_id", "part")
    return h.withColumn("in_block", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["size", "block"]).withColumn("nr", F.col("offset") + F.col("in_block")).drop("block", "offset", "in_block")


def _placing(plan: np.ndarray):
    """Batches of (item_id, part, start, size, nr) -> with bucket and container, by search in the sorted plan."""
    size, lo, each, bucket, base = plan
    keys = size << 40 | lo  # a size has fewer than 2^40 items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            s, nr = (cols[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("size", "nr"))
            at = np.searchsorted(keys, s << 40 | nr, side="right") - 1
            cols["bucket"] = pa.array(bucket[at].astype(np.int32))
            cols["container"] = pa.array(base[at] + (nr - lo[at]) // each[at])
            cols.pop("nr")
            yield pa.RecordBatch.from_pydict(cols)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, buckets: int = 32) -> DataFrame:
    """(item_id, part, start, size, bucket, container): every piece in exactly one container.

    ``items`` has (item_id, n_tokens) with each item once. No container exceeds the capacity, and only
    items above it have more than one part. An empty table gives no rows.
    """
    p = materialize(pieces(items, capacity), "p8-pieces")
    hist = histogram(p, capacity)
    used, base, plan = dict.fromkeys(range(capacity + 1), 0), 0, []
    for bucket, times, shape in batch_shapes(hist, bucket_bounds(hist, buckets), capacity):
        for s, c in shape.items():
            plan.append((s, used[s], c, bucket, base))
            used[s] += times * c
        base += times
    # at most about 2 * ``capacity`` shapes of O(sqrt(capacity)) sizes each: bounded whatever the number of items
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5).T
    return numbered(p).select("item_id", "part", "start", "size", F.col("nr").cast("long").alias("nr")).mapInArrow(
        _placing(table), "item_id bigint, part int, start int, size int, bucket int, container bigint"
    )


def histogram(p: DataFrame, capacity: int) -> np.ndarray:
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in p.groupBy("size").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        hist[r["size"]] = r["n"]
    return hist


def violations(items: DataFrame, packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (items, over_full, wrongly_cut, not_whole): the number of items packed, of containers above the
    capacity, of items cut though they fit, and of items whose pieces don't add up to them. The last three are 0."""
    full = packing.groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > capacity).alias("over_full"))
    per = packing.groupBy("item_id").agg(F.count("*").alias("parts"), F.countDistinct("start").alias("starts"), F.sum("size").alias("s"))
    j = items.join(per, "item_id", "left")
    whole = (F.col("s") == F.col("n_tokens")) & (F.col("parts") == F.col("starts"))
    cut = (F.col("n_tokens") <= capacity) & (F.col("parts") > 1)
    t = j.agg(F.count("parts").alias("items"), F.count_if(cut).alias("wrongly_cut"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("not_whole"))
    return t.crossJoin(full).select("items", "over_full", "wrongly_cut", "not_whole")  # one row each


def report(packing: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bucket, containers, pieces, tokens, fill) of each bucket."""
    return packing.groupBy("bucket").agg(
        F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("size").cast("long").alias("tokens")
    ).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
