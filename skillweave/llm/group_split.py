"""Problem 4: splits that keep related records together.

Records are linked by shared entities (here jd_id and cv_id). Components are found by repeated
contraction: every node hooks to its smallest neighbour, pointer jumping shortens the chains, and
the edges are relabelled; the graph shrinks from round to round and every round is a written table.

The component table is persisted (:class:`ComponentTable`) and updated batch by batch: components that
exist keep their split, new ones fill the deficits of the splits, and components that merge records of
different splits are quarantined. A component is named by its smallest jd entity, or by its smallest cv
entity as long as it has no jd.

Null and blank ids link nothing, an empty batch changes nothing, repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.words import norm_id
from skillweave.runtime import materialize, shared_folder

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
#: Components of over 1 / LARGE_SHARE of the rows are placed one by one; there are fewer than LARGE_SHARE.
LARGE_SHARE = 1000
MAX_ROUNDS = 60


def star_edges(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Edges (a, b) that tie all ``left`` values sharing a ``right`` value to the smallest of them.

    As many edges as distinct pairs at most: no pairs within a group are formed.
    """
    p = pairs.select(F.col(left).alias("a"), F.col(right).alias("r")).filter("a IS NOT NULL AND r IS NOT NULL").distinct()
    low = p.groupBy("r").agg(F.min("a").alias("b"), F.max("a").alias("hi")).filter("b <> hi").drop("hi")
    return p.join(low, "r").filter("a <> b").select("a", "b").distinct()


def connected(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of the component."""
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")), "cc-hook")
        parent = hook
        for _ in range(jumps):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("v", F.col("pp").alias("p"))
        parent = materialize(parent, "cc-parent")
        if labels is None:
            labels = parent.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("v").alias("root"), F.col("p").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-labels")
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("x")), parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        moved = e.join(pa, "a").join(pb, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        e = materialize(moved.distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


STATE_SCHEMA = "entity string, component string, split string, n_rows bigint"


class ComponentTable:
    """The component table under a name in the shared folder. Every commit writes a version of its own, which counts
    once it is whole; a lost or repeated commit leaves the version before it in force."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}"

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for p, n in names if n[:1] == "v" and fs.exists(done(p, "_SUCCESS")))

    def load(self) -> DataFrame | None:
        """The latest whole version; None before the first."""
        v = self.versions()
        return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/v{v[-1]}") if v else None

    def commit(self, state: DataFrame) -> DataFrame:
        n = (self.versions() or [0])[-1] + 1
        state.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        return self.load()

    def add(self, rows: DataFrame, **cols) -> DataFrame:
        """Takes a batch of rows in and gives the new state."""
        return self.commit(update(self.load(), rows, **cols))


def found(state: DataFrame) -> DataFrame:
    """(jd_lo, jd_hi): the smallest jd_id of each component with each other one, read off the component table."""
    jd = state.filter("entity LIKE 'j:%' AND entity <> component")
    return jd.select(F.expr("substring(component, 3)").alias("jd_lo"), F.expr("substring(entity, 3)").alias("jd_hi"))


def linked_pairs(train: DataFrame) -> DataFrame:
    """The pairs of one table that is the first and only batch."""
    return found(update(None, train))


def _sortable(name: Column | str) -> Column:
    """Entities so named that every jd comes before every cv, and back again."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.startswith("c:"), F.concat(F.lit("v:"), F.expr(f"substring({name}, 3)"))).when(c.startswith("v:"), F.concat(F.lit("c:"), F.expr(f"substring({name}, 3)"))).otherwise(c)


def update(state: DataFrame | None, rows: DataFrame, jd: str = "jd_id", cv: str = "cv_id", row: str = "row_id", proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """The component table after a batch: (entity, component, split, n_rows), written once.

    Entities are 'j:' + jd_id and 'c:' + cv_id, and 'r:' + row_id for rows without either (nulls link
    nothing). Rows count for their jd entity, else for the cv entity. An empty batch changes nothing.
    """
    spark = rows.sparkSession
    if state is None:
        state = spark.createDataFrame([], STATE_SCHEMA)
    batch = rows.select(
        F.concat(F.lit("j:"), norm_id(f"`{jd}`")).alias("j"), F.concat(F.lit("c:"), norm_id(f"`{cv}`")).alias("c"), F.concat(F.lit("r:"), F.col(f"`{row}`").cast("string")).alias("r")
    ).groupBy("j", "c", F.when(F.col("j").isNull() & F.col("c").isNull(), F.col("r")).alias("r")).agg(F.count("*").alias("n"))
    batch = materialize(batch, "p4-batch")
    fresh = (
        batch.select(F.coalesce("j", "c", "r").alias("entity"), "n")
        .unionByName(batch.select(F.col("c").alias("entity"), F.lit(0).cast("long").alias("n")).filter("entity IS NOT NULL"))
        .groupBy("entity").agg(F.sum("n").alias("add_rows"))
    )
    known = state.select("entity", F.col("component").alias("was"), "split", "n_rows")
    merged = materialize(
        known.join(fresh, "entity", "full").select(
            "entity", F.coalesce("was", "entity").alias("at"), F.col("was").isNotNull().alias("old"), "split",
            (F.coalesce("n_rows", F.lit(0)) + F.coalesce("add_rows", F.lit(0))).cast("long").alias("n_rows"),
        ), "p4-merged",
    )
    at = merged.select("entity", _sortable("at").alias("at"))
    pairs = (
        batch.filter("j IS NOT NULL AND c IS NOT NULL").select("j", "c").distinct()
        .join(at.withColumnsRenamed({"entity": "j", "at": "ja"}), "j").join(at.withColumnsRenamed({"entity": "c", "at": "ca"}), "c")
    )
    # a right node that already is a component's name may also stand on the left: tie the two roles together
    pairs = materialize(pairs.select("ja", "ca").distinct(), "p4-pairs")
    own = pairs.select(F.col("ca").alias("ja"), F.col("ca"))
    roots = connected(star_edges(pairs.unionByName(own), "ja", "ca")).select(_sortable("node").alias("node"), _sortable("root").alias("root"))
    comp = merged.join(roots, merged["at"] == roots["node"], "left").select("entity", F.coalesce("root", "at").alias("component"), "split", "n_rows")
    comp = materialize(comp, "p4-comp")
    sums = comp.groupBy("component").agg(F.sum("n_rows").alias("rows"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    decided = materialize(
        sums.select("component", "rows", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), F.lit(QUARANTINE)).alias("kept")), "p4-sums"
    )
    have = {r["kept"]: r["n"] for r in decided.groupBy("kept").agg(F.sum("rows").alias("n")).collect()}
    total = sum(have.values())
    usable = total - have.get(QUARANTINE, 0)
    lack = {s: p * usable - have.get(s, 0) for s, p in proportions.items()}
    new = decided.filter("kept IS NULL")
    large = new.filter(F.col("rows") * LARGE_SHARE > total).orderBy(F.col("rows").desc(), "component").collect()
    placed = []
    for r in large:  # fewer than LARGE_SHARE rows by the bound above
        s = max(lack, key=lambda k: (lack[k] / max(proportions[k], 1e-9), k)) if r["rows"] > max(lack.values()) else max(lack, key=lambda k: (lack[k], k))
        lack[s] -= r["rows"]
        placed.append((r["component"], s))
    room = {s: max(0.0, x) for s, x in lack.items()}
    if not (whole := sum(room.values())):
        room, whole = dict(proportions), sum(proportions.values())
    u = F.pmod(F.xxhash64(F.lit("split"), "component"), F.lit(1 << 30)) / float(1 << 30)
    share, pick = 0.0, None
    for s, x in room.items():
        share += x / whole
        pick = F.when(u < share, s) if pick is None else pick.when(u < share, s)
    by_hash = pick.otherwise(next(reversed(room)))
    big = spark.createDataFrame(placed, "component string, put string")
    chosen = decided.join(F.broadcast(big), "component", "left").select("component", F.coalesce("kept", "put", by_hash).alias("split"))
    return materialize(comp.drop("split").join(chosen, "component").select("entity", "component", "split", "n_rows"), "p4-state")


def assign(state: DataFrame, rows: DataFrame, jd: str = "jd_id", cv: str = "cv_id", row: str = "row_id") -> DataFrame:
    """(row_id, component, split) of each row, read off the component table."""
    key = F.coalesce(
        F.concat(F.lit("j:"), norm_id(f"`{jd}`")), F.concat(F.lit("c:"), norm_id(f"`{cv}`")), F.concat(F.lit("r:"), F.col(f"`{row}`").cast("string"))
    )
    r = rows.select(F.col(f"`{row}`").alias("row_id"), key.alias("entity"))
    return r.join(state.select("entity", "component", "split"), "entity").select("row_id", "component", "split")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(component, n_rows, n_before, state) of every component after a batch: how many components it unites, and
    'new', 'kept' or 'quarantined'. What is kept or quarantined follows from the splits before."""
    was = before.select("entity", F.col("component").alias("old"), F.col("split").alias("old_split"))
    j = after.join(was, "entity", "left")
    g = j.groupBy("component").agg(
        F.sum("n_rows").alias("n_rows"), F.countDistinct("old").alias("n_before"), F.min("old_split").alias("lo"), F.max("old_split").alias("hi"), F.min("split").alias("s0"), F.max("split").alias("s1")
    )
    one = F.col("s0") == F.col("s1")
    clash = (F.col("lo") != F.col("hi")) | (F.col("lo") == QUARANTINE)
    state = (
        F.when(F.col("lo").isNull() & one & F.col("s0").isin(*PROPORTIONS), "new").when(~clash & one & (F.col("s0") == F.col("lo")), "kept")
        .when(clash & one & (F.col("s0") == QUARANTINE), "quarantined").otherwise("wrong")
    )
    return g.select("component", "n_rows", "n_before", state.alias("state"))


def shares(assigned: DataFrame, proportions: Mapping[str, float] = PROPORTIONS, within: float = 0.01) -> DataFrame:
    """(split, n_rows_all, met): per split, the number of rows assigned in all, and whether its share of them is met."""
    total = assigned.agg(F.count("*").alias("n_rows_all"))
    want = assigned.sparkSession.createDataFrame(list(proportions.items()), "split string, share double")
    n = assigned.groupBy("split").agg(F.count("*").alias("n"))
    j = want.join(n, "split", "left").crossJoin(total)  # three rows and one row
    return j.select("split", "n_rows_all", (F.abs(F.coalesce("n", F.lit(0)) / F.col("n_rows_all") - F.col("share")) <= within).alias("met"))
