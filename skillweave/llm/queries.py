"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skillweave.llm import canonical_dupes, canonical_map, cross_split, group_split, leakage, packing, pii, rank_fusion, residue, top_groups
from skillweave.llm.oracle import ORACLE  # noqa: F401
from skillweave.llm.words import norm_id
from skillweave.runtime import materialize, table


def p1_found(s, d):
    return canonical_dupes.found(table(s, d, "dataset_train"))


def p1_collapsed(s, d):
    g = canonical_dupes.collapse(canonical_dupes.fingerprints(table(s, d, "dataset_train"), "row_id"))
    return g.select("keep_id", "copies")


def p2_found(s, d):
    return cross_split.overlaps(table(s, d, "dataset_train"), table(s, d, "dataset_test")).select("train_row_id", "test_row_id")


def p2_report(s, d):
    return cross_split.report(p2_found(s, d), table(s, d, "dataset_test"))


def _texts(s, d):
    return pii.texts_of(table(s, d, "dataset_train"), table(s, d, "cv"))


def p3_found(s, d):
    return pii.find(_texts(s, d))


def p3_redacted(s, d):
    return pii.redacted(_texts(s, d))


def _components(s):
    """A component table of its own for each run: the queries start from an empty one."""
    return group_split.ComponentTable(s, f"p4-components-{uuid.uuid4().hex}")


def p4_found(s, d):
    return group_split.found(_components(s).add(table(s, d, "dataset_train")))


def p4_splits(s, d):
    t = table(s, d, "dataset_train")
    return group_split.assign(_components(s).add(t), t)


def _two_deliveries(s, d):
    """The component table after the rows loaded before 2024, and then the rest (rows without a date come last)."""
    t = table(s, d, "dataset_train")
    early = F.coalesce(F.col("loaded_at") < F.lit("2024-01-01").cast("timestamp"), F.lit(False))
    comps = _components(s)
    first = comps.add(t.filter(early))
    return t, first, comps.add(t.filter(~early))


def p4_incremental(s, d):
    """Per component after two deliveries: its rows and whether its split is kept, new, or quarantined because the
    delivery ties components of different splits together."""
    _, first, state = _two_deliveries(s, d)
    c = group_split.changes(first, state)
    return c.select("component", "n_rows", "n_before", (F.col("state") != "wrong").alias("sound"))


def p4_components(s, d):
    t = table(s, d, "dataset_train")
    return group_split.assign(_components(s).add(t), t).select("row_id", "component")


def p4_shares(s, d):
    """The splits' shares of the rows: whether each is within a point of the wanted one, and rows left without a split."""
    t = table(s, d, "dataset_train")
    a = materialize(group_split.assign(_components(s).add(t), t), "p4-assigned")
    return group_split.shares(a)


def p5_found(s, d):
    return top_groups.found(table(s, d, "dataset_train"))


def p6_found(s, d):
    return canonical_map.found(table(s, d, "cv"), table(s, d, "job"), table(s, d, "skills_processed"), table(s, d, "skill_alias"))


def p7_found(s, d):
    return rank_fusion.found(table(s, d, "features"))


def p7_ranking(s, d):
    r = rank_fusion.ranking(table(s, d, "features"), rank_fusion.SCORES)
    return r.select(F.col("grp").alias("jd_id"), F.col("item").alias("cv_id"), "rrf", "place")


def p7_weighted(s, d):
    """The fused ranking with the weights of the first configuration: that of BM25, 1 for the vectors, that of the skills."""
    c = table(s, d, "feature_config").orderBy("config_id").select("bm25_full_weight", "final_skill_weight").first()
    r = rank_fusion.ranking(table(s, d, "features"), rank_fusion.SCORES, weights=(c["bm25_full_weight"], 1.0, c["final_skill_weight"]))
    return r.select(F.col("grp").alias("jd_id"), F.col("item").alias("cv_id"), "rrf")


def p8_packing(s, d):
    items = materialize(packing.sizes(table(s, d, "documents")), "p8-sizes")
    return packing.pack(items)


def p8_report(s, d):
    return packing.report(p8_packing(s, d))


def p8_violations(s, d):
    items = materialize(packing.sizes(table(s, d, "documents")), "p8-sizes")
    return packing.violations(items, materialize(packing.pack(items), "p8-packed"))


def p9_found(s, d):
    return leakage.leaks(table(s, d, "documents"), table(s, d, "eval_item"))


def p9_report(s, d):
    return leakage.report(materialize(p9_found(s, d), "p9-found"), table(s, d, "eval_item"), table(s, d, "documents"))


def p10_found(s, d):
    return residue.found(table(s, d, "documents"))


def p10_clean(s, d):
    return residue.clean(table(s, d, "documents")).select("doc_id", "text")


QUERIES = {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
