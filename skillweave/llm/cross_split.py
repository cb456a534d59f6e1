"""Problem 2: records of the evaluation splits that repeat, exactly or almost, in the training split.

A weighted cosine join over inverted lists. Every text is a vector of its distinct words, weighted by
their rarity ln(texts / texts with the word); words in at most one of ``FREQUENT`` texts all have the
largest weight. A wanted pair shares at least ``t`` of the words of either text (overlap >= t), so that its
dot product is at least the sum of the smallest squared weights of that many words of the text: a bound
``least`` of each vector's own, by which no wanted pair is lost whatever the weights are.

* Residual-norm pruning: words are put in order of falling weight; a vector is listed only under its first
  words, until the squared norm of what remains is below ``least``. Any wanted pair shares a listed word.
* At the first word that a pair shares, the residual norms of both vectors (``tail``) bound the dot product
  still possible, and so does the number of words left times the weight of this one (maximum-weight
  pruning, as no later word weighs more). Pairs below ``least`` of either vector are dropped.
* A bitmap of 128 bits per text bounds the number of differing words from below and drops nearly all
  remaining pairs; the exact dot products and overlaps are computed for the rest.

The job descriptions, of which there are few different ones, are joined first (they are told apart by
128-bit hashes); resumes are only compared below a pair of similar descriptions. Lists are keyed by
(description, word), so that neither a description with a tenth of all rows nor a frequent word alone
makes a list. No cap is set on partners or candidates; the adaptive skew join splits long lists.

Null texts and texts without a word have no partners, repeated rows each count, empty tables give no rows,
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.llm.words import norm_words
from skillweave.runtime import broadcast_if_small, materialize

JACCARD = 0.8
#: Words in over 1 / FREQUENT of the texts are ordered by frequency; all others count as rare and go first.
FREQUENT = 1000
SLACK = 1e-6  # for sums in another order


def word_hashes(text: Column) -> Column:
    """The distinct words of a text as sorted 64-bit hashes."""
    return F.array_sort(F.transform(F.array_distinct(F.split(norm_words(text), " ")), lambda w: F.xxhash64(w)))


def frequent_words(sets: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and squared weights of the frequent words, over all texts, by hash. Their number is bounded
    by FREQUENT times the mean number of words of a text, whatever the number of texts."""
    total = sets.count()
    df = sets.select(F.explode(col).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") * FREQUENT > total)
    rows = df.toArrow()
    keys, n = rows["w"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], np.maximum(np.log(total / n[order]), 0.01) ** 2


def squared_weights(frequent: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> np.ndarray:
    keys, squares = frequent
    rare = np.full(len(words), np.log(FREQUENT) ** 2)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, squares[at], rare)
    return rare


def _listed(frequent: tuple[np.ndarray, np.ndarray], t: float):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("words")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), sizes)
            sq = squared_weights(frequent, flat)
            o = np.lexsort((flat, -sq, row))
            flat, row, sq = flat[o], row[o], sq[o]
            start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            pos = np.arange(len(flat)) - start[row]
            bit = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)  # 0 .. 127
            maps = np.zeros((b.num_rows, 2), dtype=np.uint64)
            np.bitwise_or.at(maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            last = sizes[row] - np.ceil(t * sizes[row] - 1e-9).astype(np.int64)
            keep = pos <= last
            run = np.concatenate((np.cumsum(sq[::-1])[::-1], [0.0]))
            tail = run[:-1] - run[np.minimum(start + sizes, len(flat))][row]  # squared norm from here to the vector's end
            least = tail[np.minimum(start[row] + last, len(flat) - 1)]
            r, k = row[keep], pa.array(flat[keep])
            out = {"w": k, "pos": pa.array(pos[keep].astype(np.int32)), "n": pa.array(sizes[r].astype(np.int32)), "sq": pa.array(sq[keep]), "tail": pa.array(tail[keep]), "least": pa.array(least[keep]), "m0": pa.array(maps[r, 0].view(np.int64)), "m1": pa.array(maps[r, 1].view(np.int64))}
            for name in b.schema.names:
                if name != "words":
                    out[name] = b.column(name).take(pa.array(r))
            yield pa.RecordBatch.from_pydict(out)

    return run


def listed(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], t: float = JACCARD) -> DataFrame:
    """The inverted lists: (w, pos, n, sq, tail, least, m0, m1, other columns) for each word before the residual.

    ``sets`` has a column ``words`` (ARRAY<BIGINT>) and any others but those named.
    """
    rest = [f for f in sets.schema.fields if f.name != "words"]
    schema = "w bigint, pos int, n int, sq double, tail double, least double, m0 bigint, m1 bigint" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return sets.filter(F.size("words") > 0).mapInArrow(_listed(frequent, t), schema)


def bound(a: DataFrame, b: DataFrame, t: float = JACCARD) -> Column:
    """What the list entries of a wanted pair at its first shared word satisfy: residual norms, the largest weight left,
    lengths, positions and bitmaps leave room for the threshold."""
    need = F.ceil((a["n"] + b["n"]) * (t / (1 + t)) - 1e-9)
    differ = F.bit_count(a["m0"].bitwiseXOR(b["m0"])) + F.bit_count(a["m1"].bitwiseXOR(b["m1"]))
    least = F.greatest(a["least"], b["least"]) - SLACK
    norms = (a["tail"] >= least) & (b["tail"] >= least) & (F.least(a["n"] - a["pos"], b["n"] - b["pos"]) * a["sq"] >= least)
    return norms & (a["n"] - a["pos"] >= need) & (b["n"] - b["pos"] >= need) & (differ <= a["n"] + b["n"] - 2 * need)


def _exact(frequent: tuple[np.ndarray, np.ndarray], t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sides = []
            for name in ("x", "y"):
                c = b.column(name)
                ends = np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))
                sides.append(np.split(pc.list_flatten(c).to_numpy(zero_copy_only=False), ends[:-1]))
            both = [np.intersect1d(x, y, assume_unique=True) for x, y in zip(*sides)]
            n = np.array([len(s) for s in both])
            total = np.array([len(x) + len(y) for x, y in zip(*sides)])
            sums = lambda parts: np.array([squared_weights(frequent, p).sum() for p in parts])
            dot = sums(both)
            cosine = dot / np.sqrt(np.maximum(sums(sides[0]) * sums(sides[1]), 1e-300))
            keep = pa.array(n >= t * (total - n) - 1e-9)
            out = {name: b.column(name) for name in b.schema.names if name not in ("x", "y")}
            yield pa.RecordBatch.from_pydict({**out, "dot": pa.array(dot), "cosine": pa.array(cosine)}).filter(keep)

    return run


def exact(pairs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], t: float) -> DataFrame:
    """The pairs whose word sets ``x`` and ``y`` overlap by at least t, with their exact dot product and cosine."""
    rest = [f for f in pairs.schema.fields if f.name not in ("x", "y")]
    return pairs.mapInArrow(_exact(frequent, t), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", dot double, cosine double")


def similar_sets(left: DataFrame, right: DataFrame, t: float = JACCARD) -> DataFrame:
    """(a, b) of sets (id, words) of either side whose words overlap by at least t."""
    f = frequent_words(left.unionByName(right), "words")
    a, b = listed(left.withColumnRenamed("id", "a"), f, t), listed(right.withColumnRenamed("id", "b"), f, t)
    cand = a.join(b, (a["w"] == b["w"]) & bound(a, b, t)).select("a", "b").distinct()
    both = cand.join(left.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(right.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return exact(both, f, t).select("a", "b")


def _key(text: Column | str) -> Column:
    return F.unhex(F.md5(text))


def _sets(texts: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(text_key, id) of each distinct text, and (id, words) of each distinct set of words."""
    d = texts.select(F.col(col).alias("text")).filter("text IS NOT NULL").distinct()
    own = F.array_join(F.array_sort(F.array_distinct(F.split(norm_words("text"), " "))), " ")
    d = materialize(d.select(_key("text").alias("text_key"), word_hashes(F.col("text")).alias("words"), _key(own).alias("id")), "p2-jd")
    return d.select("text_key", "id"), d.groupBy("id").agg(F.first("words").alias("words"))


def overlaps(train: DataFrame, test: DataFrame, t: float = JACCARD) -> DataFrame:
    """(train_row_id, test_row_id, dot, cosine) of all pairs whose resumes and descriptions both overlap by at least t;
    dot product and cosine are those of the resumes."""
    cols = [F.col("row_id"), F.col("resume_text"), F.col("job_description_text")]
    tr, te = (x.select(*cols).filter("resume_text IS NOT NULL AND job_description_text IS NOT NULL") for x in (train, test))
    tr_key, tr_sets = _sets(tr, "job_description_text")
    te_key, te_sets = _sets(te, "job_description_text")
    links = materialize(similar_sets(tr_sets, te_sets, t), "p2-links")  # (a of train, b of test)

    def rows(x: DataFrame, keys: DataFrame, side: str) -> DataFrame:
        known = keys.join(links.select(F.col(side).alias("id")).distinct(), "id", "left_semi")
        r = x.select("row_id", _key("job_description_text").alias("text_key"), "resume_text")
        r = r.join(broadcast_if_small(known), "text_key").select("row_id", "id", word_hashes(F.col("resume_text")).alias("words"))
        return materialize(r, f"p2-{side}")

    tr_rows, te_rows = rows(tr, tr_key, "a"), rows(te, te_key, "b")
    f = frequent_words(tr_rows.select("words").unionByName(te_rows.select("words")), "words")
    a = listed(tr_rows.withColumnsRenamed({"row_id": "train_row_id", "id": "a"}), f, t)
    b = listed(te_rows.withColumnsRenamed({"row_id": "test_row_id", "id": "b"}), f, t).join(broadcast_if_small(links), "b")
    cand = a.join(b, (a["a"] == b["a"]) & (a["w"] == b["w"]) & bound(a, b, t)).select("train_row_id", "test_row_id").distinct()
    cand = materialize(cand, "p2-cand")
    keep_a, keep_b = (materialize(cand.select(F.col(c).alias("row_id")).distinct(), "p2-ids") for c in ("train_row_id", "test_row_id"))
    x = tr_rows.join(broadcast_if_small(keep_a), "row_id", "left_semi").select(F.col("row_id").alias("train_row_id"), F.col("words").alias("x"))
    y = te_rows.join(broadcast_if_small(keep_b), "row_id", "left_semi").select(F.col("row_id").alias("test_row_id"), F.col("words").alias("y"))
    return exact(cand.join(x, "train_row_id").join(y, "test_row_id"), f, t)


def report(pairs: DataFrame, test: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_test_rows) of the overlaps."""
    src = test.select(F.col("row_id").alias("test_row_id"), "split", "source")
    return pairs.join(src, "test_row_id").groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("test_row_id").alias("n_test_rows"))
