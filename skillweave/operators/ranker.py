"""Learning to rank: gradient-boosted trees with the LambdaMART gradient and monotone splits.

Spark ML has no ranking objective and no monotone trees. The fit runs in NumPy on a bounded sample of
labelled rows (``RankerConfig.max_rows``, sampled by group hash so that groups stay whole); scoring is a
column expression over any number of rows.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions.ids import draw
from skillweave.schema import RankerConfig


def encode_labels(df: DataFrame, label: str, mapping: dict | None = None, out: str = "y") -> DataFrame:
    """Integer labels from 0: by the mapping (an unknown label is an error), else rounded half to even and shifted to 0."""
    if mapping:
        table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
        known = F.element_at(table, F.col(label))
        return df.withColumn(out, F.when(F.col(label).isNotNull() & known.isNull(), F.raise_error(F.concat(F.lit("unmapped label: "), F.col(label).cast("string"))).cast("int")).otherwise(known))
    y = F.rint(F.col(label).cast("double")).cast("int")
    low = df.agg(F.min(y).alias("low_"))
    return df.join(F.broadcast(low)).withColumn(out, y - F.col("low_")).drop("low_")


def valid_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups with at least two rows and different labels."""
    ok = df.groupBy(group).agg(F.count("*").alias("n_"), F.min(label).alias("a_"), F.max(label).alias("b_")).filter("n_ >= 2 AND b_ > a_")
    return df.join(ok.select(group), group, "left_semi")


def group_split(df: DataFrame | None, group: str, share: float = 0.2, seed: int = 42) -> Column:
    """True for rows of the validation groups; rows without a group are for training."""
    return F.coalesce(F.pmod(draw(F.lit(str(seed)), F.col(group).cast("string")), F.lit(10_000)) < int(share * 10_000), F.lit(False)) & F.col(group).isNotNull()


def three_way(row: str, seed: int = 42) -> Column:
    """'train', 'validation' or 'test' at 80/10/10, row by row."""
    u = F.pmod(draw(F.lit(str(seed)), F.col(row).cast("string")), F.lit(10))
    return F.when(u < 8, "train").when(u < 9, "validation").otherwise("test")


def rank(scored: DataFrame, group: str, pred: str, item: str, topk: int | None = None) -> DataFrame:
    """The best rows of each group by ``pred``; groups of one row are dropped, ties by the smaller item."""
    big = scored.groupBy(group).agg(F.count("*").alias("n_")).filter("n_ >= 2").select(group)
    s = scored.join(big, group, "left_semi")
    if topk is None:
        from skillweave.operators.norm import place

        return place(s, group, [F.col(pred).desc(), F.col(item).asc()], "p_").withColumn("place", (F.col("p_") + 1).cast("int")).drop("p_")
    salted = s.withColumn("salt_", F.pmod(F.xxhash64(item), F.lit(16)))
    best = [F.col(pred).desc(), F.col(item).asc()]
    a = salted.withColumn("r_", F.row_number().over(Window.partitionBy(group, "salt_").orderBy(*best))).filter(F.col("r_") <= topk).drop("salt_", "r_")
    return a.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*best))).filter(F.col("place") <= topk)


class LambdaMart:
    def __init__(self, cfg: RankerConfig = RankerConfig()):
        self.cfg, self.trees = cfg, []

    def fit_arrays(self, x: np.ndarray, y: np.ndarray, qid: np.ndarray) -> LambdaMart:
        c = self.cfg
        order = np.argsort(qid, kind="stable")
        x, y, qid = x[order], y[order], qid[order]
        starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
        groups = list(zip(starts, np.r_[starts[1:], len(qid)]))
        bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        s = np.zeros(len(y))
        self.trees = []
        for _ in range(c.n_trees):
            g, h = np.zeros(len(y)), np.full(len(y), 1e-9)
            for a, b in groups:
                self._lambdas(s[a:b], y[a:b], g[a:b], h[a:b])
            tree = self._grow(x, g, h, np.arange(len(y)), bins, 0, -np.inf, np.inf)
            self.trees.append(tree)
            s += self._values(tree, x)
        return self

    def _lambdas(self, s, y, g, h) -> None:
        n = len(s)
        pos = np.empty(n, dtype=int)
        pos[np.lexsort((np.arange(n), -s))] = np.arange(n)
        gain, disc = (2.0**y - 1) if self.cfg.gain_mode == "exp" else y.astype(float), 1 / np.log2(pos + 2.0)
        ideal = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2.0)).sum()
        if ideal <= 0:
            return
        for lo in range(0, n, 512):  # blocks keep the pair matrix small
            i = slice(lo, min(n, lo + 512))
            better = y[i, None] > y[None, :]
            d = np.abs((gain[i, None] - gain[None, :]) * (disc[i, None] - disc[None, :])) / ideal
            rho = 1 / (1 + np.exp(np.clip(s[i, None] - s[None, :], -50, 50)))
            lam, hes = np.where(better, d * rho, 0), np.where(better, d * rho * (1 - rho), 0)
            g[i] += lam.sum(1)
            h[i] += hes.sum(1)
            g -= lam.sum(0)
            h += hes.sum(0)

    def _grow(self, x, g, h, idx, bins, depth, lo, hi):
        c = self.cfg
        value = float(np.clip(g[idx].sum() / (h[idx].sum() + c.l2), lo, hi))
        if depth >= c.max_depth or len(idx) < 20:
            return c.learning_rate * value
        best = (1e-9, None, None)
        gs, hs = g[idx].sum(), h[idx].sum()
        for f, cuts in enumerate(bins):
            if not len(cuts):
                continue
            b = np.searchsorted(cuts, x[idx, f], side="left")
            gl = np.cumsum(np.bincount(b, g[idx], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[idx], len(cuts) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            vl, vr = gl / (hl + c.l2), (gs - gl) / (hs - hl + c.l2)
            score = gl * vl + (gs - gl) * vr - gs * gs / (hs + c.l2)
            bad = (nl < 5) | (len(idx) - nl < 5)
            if c.monotone_positive:
                bad |= vl > vr
            score = np.where(bad, -1, score)
            k = int(score.argmax())
            if score[k] > best[0]:
                best = (score[k], f, float(cuts[k]))
        if best[1] is None:
            return c.learning_rate * value
        _, f, cut = best
        left = x[idx, f] <= cut
        li, ri = idx[left], idx[~left]
        mid = (np.clip(g[li].sum() / (h[li].sum() + c.l2), lo, hi) + np.clip(g[ri].sum() / (h[ri].sum() + c.l2), lo, hi)) / 2
        l_hi, r_lo = (min(hi, mid), max(lo, mid)) if c.monotone_positive else (hi, lo)
        return [f, cut, self._grow(x, g, h, li, bins, depth + 1, lo, l_hi), self._grow(x, g, h, ri, bins, depth + 1, r_lo, hi)]

    @staticmethod
    def _values(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, list):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, LambdaMart._values(a, x), LambdaMart._values(b, x))

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        return sum((self._values(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, df: DataFrame, group: str, label: str) -> LambdaMart:
        """Fits on at most ``max_rows`` rows: of a group over ``max_group_rows`` that many rows by their hash, of all groups
        as many as the bound allows, chosen by the hash of the group."""
        c = self.cfg
        d = valid_groups(df, group, label)
        sizes = d.groupBy(group).agg(F.count("*").alias("n_"))
        n = sizes.agg(F.sum(F.least("n_", F.lit(c.max_group_rows)))).first()[0] or 0
        d = d.join(sizes, group)
        # a group's sample is drawn at nine tenths of its bound, so that its random size stays below it
        share = F.when(F.col("n_") > c.max_group_rows, 0.9 * c.max_group_rows / F.col("n_")).otherwise(1.0)
        d = d.filter(F.pmod(F.xxhash64(F.lit(c.seed), *[F.col(x) for x in (group, label, *c.features)]), F.lit(1 << 30)) < share * (1 << 30)).drop("n_")
        if n > c.max_rows:
            d = d.filter(F.pmod(F.xxhash64(F.lit(c.seed), F.col(group)), F.lit(1_000_000)) < int(900_000 * c.max_rows / n))
        d = d.limit(c.max_rows)  # never reached but by an odd draw
        t = d.select(F.xxhash64(group).alias("q"), F.col(label).cast("double").alias("y"), *[F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0)).alias(f) for f in c.features]).toArrow()
        cols = [t[f].to_numpy() for f in c.features]
        return self.fit_arrays(np.column_stack(cols) if len(t) else np.zeros((0, len(cols))), t["y"].to_numpy(), t["q"].to_numpy())

    def column(self) -> Column:
        """The score as a column expression over the feature columns."""
        def node(t) -> Column:
            if not isinstance(t, list):
                return F.lit(float(t))
            f, cut, a, b = t
            return F.when(F.coalesce(F.col(self.cfg.features[f]), F.lit(0.0)) <= cut, node(a)).otherwise(node(b))

        out = F.lit(0.0)
        for t in self.trees:
            out = out + node(t)
        return out

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Scores in Arrow batches (a sum of hundreds of trees would be too large an expression)."""
        feats, trees = list(self.cfg.features), self.trees

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            x = rows.fillna(0.0).to_numpy(dtype=float)
            return pd.Series(sum((LambdaMart._values(t, x) for t in trees), np.zeros(len(x))))

        return df.withColumn(out, score(F.struct(*[F.col(f).cast("double").alias(f) for f in feats])))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"features": self.cfg.features, "config": {k: v for k, v in self.cfg.__dict__.items() if k != "extra"}, "trees": self.trees}))

    @classmethod
    def load(cls, path: str) -> LambdaMart:
        """Unknown configuration keys are dropped."""
        d = json.loads(Path(path).read_text())
        known = {k: (tuple(v) if isinstance(v, list) else v) for k, v in d["config"].items() if k in RankerConfig.__dataclass_fields__}
        m = cls(RankerConfig(**known))
        m.trees = d["trees"]
        return m


def monotone_constraints(features: tuple[str, ...], positive: bool = True) -> str:
    return "(" + ",".join(("1" if positive else "0") for _ in features) + ")"
