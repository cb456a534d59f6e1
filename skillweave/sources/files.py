"""Readers and writers of the file formats in use."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.functions.text import collapse, norm_text, slugify
from skillweave.schema import require_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks. Without a schema all columns are strings."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_pairs(spark: SparkSession, path: str, labels: dict[str, int] | None = None) -> DataFrame:
    """Labelled pairs of a training CSV; rows without a text or (with ``labels``) a known label are dropped."""
    df = require_columns(read_csv(spark, path), ["resume_text", "job_description_text", "label"])
    y = F.col("label").cast("int")
    if labels:
        table = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
        y = F.coalesce(F.element_at(table, F.col("label")), y)
    return df.withColumn("label", y).na.drop(subset=["resume_text", "job_description_text", "label"])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, canonical, aliases) of {category: {canonical: [aliases]}} files. Files are read in the order of
    their names; one that doesn't parse is skipped, null aliases are dropped."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    d = raw.select("file", F.from_json("value", "map<string,map<string,array<string>>>", {"mode": "PERMISSIVE"}).alias("m")).filter("m IS NOT NULL")
    e = d.select("file", F.posexplode(F.map_entries("m")).alias("p1", "cat")).select("file", "p1", F.posexplode(F.map_entries("cat.value")).alias("p2", "c"))
    e = e.select("file", "p1", "p2", norm_text("c.key").alias("canonical"), F.posexplode_outer("c.value").alias("p3", "alias"))
    e = e.filter("canonical <> ''").withColumn("alias", norm_text("alias"))
    at = F.struct("file", "p1", "p2", "p3")
    ord_ = e.groupBy("canonical").agg(F.min(F.struct("file", "p1", "p2")).alias("o"))
    first = e.filter("alias <> ''").groupBy("canonical", "alias").agg(F.min(at).alias("at"))
    lists = first.groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda s: s["alias"]).alias("aliases"))
    from skillweave.functions.ids import rank_globally

    ranked = rank_globally(ord_, [F.col("o"), F.col("canonical")], "ord").select("ord", "canonical")
    return ranked.join(lists, "canonical", "left").select("ord", "canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def read_occupations(spark: SparkSession, path: str) -> DataFrame:
    """(occ_id, label, text, slug) of a TSV with or without a byte-order mark; rows without id or text are skipped."""
    df = read_csv(spark, path, sep="\t")
    df = require_columns(df.toDF(*[c.lstrip("﻿") for c in df.columns]), ["occ_id", "text"])
    t = df.select(F.trim("occ_id").alias("occ_id"), F.trim("text").alias("text")).filter("occ_id <> '' AND text <> ''")
    label = F.trim(F.split("text", r" \| ")[0])
    return t.select("occ_id", label.alias("label"), "text", slugify(label).alias("slug"))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(slug, bucket, canonical, aliases) of {slug: {essential: {...}, optional: {...}}}."""
    raw = spark.read.option("wholetext", True).text(path)
    m = raw.select(F.explode(F.from_json("value", "map<string,map<string,map<string,array<string>>>>")).alias("slug", "b"))
    m = m.select("slug", F.explode("b").alias("bucket", "c")).filter(F.col("bucket").isin("essential", "optional"))
    return m.select("slug", "bucket", F.explode("c").alias("canonical", "aliases"))


def read_files(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error) of every file of a folder; a file that fails doesn't stop the others. The extractor
    (for PDF or anything else) is a parameter."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for b in pdf["content"]:
                try:
                    texts.append(extract(b))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any broken file is reported, none stops the scan
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errors})

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")
    return df.withColumn("text", collapse("text")).filter("error IS NOT NULL OR text <> ''")


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array as text, non-ASCII kept; for results small enough for one file."""
    df.select(F.to_json(F.struct("*")).alias("j")).agg(F.to_json(F.array_sort(F.collect_list("j"))).alias("v")).select(
        F.concat(F.lit("["), F.array_join(F.from_json("v", "array<string>"), ","), F.lit("]")).alias("value")
    ).coalesce(1).write.mode("overwrite").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_version(df: DataFrame, path: str, at: int | None = None) -> str:
    """A new version beside the old ones (which are the backups); returns its folder."""
    v = f"{path}/v={at if at is not None else time.time_ns()}"
    df.write.mode("errorifexists").parquet(v)
    return v


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.join(F.broadcast(df.agg(F.max("v").alias("v"))), "v").drop("v")


def read_gold_skills(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, skills) of [{text, skills}]."""
    d = spark.read.option("multiLine", True).schema("text string, skills array<string>").json(path)
    return d.withColumn("doc_id", F.xxhash64("text")).select("doc_id", "text", F.array_distinct(F.transform("skills", lambda s: F.lower(F.trim(s)))).alias("skills"))


def gold_from_entities(df: DataFrame, label: str = "SKILL") -> DataFrame:
    """(doc_id, text, skills) of (doc_id, text, entities ARRAY<STRUCT<start, end, label>>): the marked pieces."""
    e = F.filter("entities", lambda x: x["label"] == label)
    return df.select("doc_id", "text", F.array_distinct(F.transform(e, lambda x: F.lower(F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"])))).alias("skills"))


def read_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JDs and CVs of {jds: [...], cvs: [...]} with defaults for missing fields."""
    schema = "jds array<struct<job_title string, job_requirement string, job_description string, job_location string>>, cvs array<struct<resume_text string, cv_location string>>"
    d = spark.read.option("multiLine", True).schema(schema).json(path)
    fill = lambda df: df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
    return fill(d.select(F.explode("jds").alias("x")).select("x.*")), fill(d.select(F.explode("cvs").alias("x")).select("x.*"))
